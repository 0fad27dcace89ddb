r"""Order MinHash fingerprints, by DataFrame functions alone.

A text is a sequence of words, and its k-mers are runs of k words. Each k-mer
is numbered by how often it occurred before in the text, so that repeats are
different items, and items are ordered by a hash of k-mer and number together.
The hash also deals items into bins; of each bin the least items are selected,
put back into the order in which they stand in the text, and hashed as a tuple.
Texts that hold the same k-mers in another order thus differ: the share of equal
entries follows edit distance and not only overlap.

All of it happens inside a row, on arrays of longs: a k-mer is packed as hash
and position. Sorted, equal k-mers stand side by side, earlier positions first,
so a binary search for the first of them gives the number. Items are packed
alike as bin, hash and position, and a second sort yields the bins and the least
items of each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .jobs import cut, table

PLACE_BITS = 30
HASH_BITS = 27


@dataclass(frozen=True)
class Order:
    """Words in a k-mer, bins (entries of a fingerprint; a power of two), items of a tuple."""

    k: int = 2
    bins: int = 64
    items: int = 2


def fingerprint(df: DataFrame, text: str, out: str, how: Order = Order()) -> DataFrame:
    """Adds ``out``: an array of longs, bin in the high and tuple hash in the low half, by bin.

    Null and empty texts and those without words have an empty array. A text of
    fewer words than k has one k-mer, all of it. Columns that start with
    ``_omh`` are used on the way.
    """
    bits = how.bins.bit_length() - 1
    mask = (1 << (bits + HASH_BITS)) - 1
    w, p, s = "_omh_words", "_omh_packed", "_omh_least"
    low = F.lit((1 << PLACE_BITS) - 1)
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    df = df.withColumn(w, F.transform(words, lambda x: F.xxhash64(x)))

    def packed(hashed: Column, place: Column) -> Column:
        return F.shiftleft(hashed.bitwiseAND(F.lit(mask)), PLACE_BITS).bitwiseOR(place)

    def kmer(x: Column, i: Column) -> Column:
        run = F.xxhash64(x, *[F.get(F.col(w), i + j) for j in range(1, how.k)]) if how.k > 1 else x
        return packed(run, F.least(i.cast("long"), low))

    heads = F.slice(F.col(w), F.lit(1), F.greatest(F.least(F.size(w), F.lit(1)), F.size(w) - (how.k - 1)))
    df = df.withColumn(p, F.sort_array(F.transform(heads, kmer)))

    def item(x: Column, i: Column) -> Column:
        """The k-mer itself where it stands first, else the hash of k-mer and number."""
        own = F.shiftright(x, PLACE_BITS)
        start = F.shiftleft(own, PLACE_BITS)
        steps = F.array(*[F.lit(1 << b) for b in range(24, -1, -1)])
        before = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(F.col(p), n + step - 1) < start, n + step).otherwise(n))
        again = (i > 0) & (F.shiftright(F.get(F.col(p), i - 1), PLACE_BITS) == own)
        return F.when(again, packed(F.xxhash64(own, i - before), x.bitwiseAND(low))).otherwise(x)

    df = df.withColumn(p, F.sort_array(F.transform(F.col(p), item)))

    def bin_of(x: Column) -> Column:
        return F.shiftright(x, PLACE_BITS + HASH_BITS)

    # Sorted: an item is among the least of its bin unless the one `items` places before is of the bin too.
    least = F.filter(F.col(p), lambda x, i: (i < how.items) | (bin_of(x) != bin_of(F.get(F.col(p), i - how.items))))
    df = df.withColumn(s, least)

    def entry(x: Column, i: Column) -> Column:
        """Bin and hash of the tuple that begins with the i-th selected item."""
        group = [F.get(F.col(s), i + j) for j in range(how.items)]
        group = [F.when(bin_of(y) == bin_of(x), F.struct(y.bitwiseAND(low).alias("place"), F.shiftright(y, PLACE_BITS).alias("item"))) for y in group]
        ordered = F.array_sort(F.filter(F.array(*group), lambda z: z.isNotNull()))
        tuple_hash = F.xxhash64(F.transform(ordered, lambda z: z["item"]))
        return F.shiftleft(bin_of(x), 32).bitwiseOR(tuple_hash.bitwiseAND(F.lit(0xFFFFFFFF)))

    first = F.transform(F.col(s), lambda x, i: F.when((i == 0) | (bin_of(x) != bin_of(F.get(F.col(s), i - 1))), entry(x, i)))
    return df.withColumn(out, F.filter(first, lambda x: x.isNotNull())).drop(w, p, s)


def likeness(a: Column, b: Column) -> Column:
    """Equal entries as a share of the bins that either text fills; 1 for two empty ones."""
    def bins(x: Column) -> Column:
        return F.transform(x, lambda e: F.shiftright(e, 32))

    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(1.0)).cast("double")


def shown(a: Column) -> Column:
    """A fingerprint as a string of hexadecimal entries."""
    return F.array_join(F.transform(a, lambda e: F.lpad(F.hex(e), 10, "0")), "")


def _following():  # noqa: ANN202
    return Window.partitionBy("block").orderBy(F.desc("place"), F.desc("text"))


def followed(docs: DataFrame, block_bytes: int = 4 << 20, most_blocks: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Each document with the text of the next one: the row with the next smaller doc_id, after the last the first.

    Rows are ordered by doc_id and a hash of the text (``place``) and cut into
    ranges of about ``block_bytes`` (``block``, larger places in larger blocks):
    bounds are places of a sample by hash, eight a block, so any spread of ids and
    any number of rows with one id will do. A binary search in the array of
    bounds, at most ``most_blocks`` of them, gives a row's block. Inside a block
    the next text comes from a window (``next``; ``inside`` is null for the last
    row). For that row it is the first text of the next block: the second table
    (block, seam_text). Texts are shuffled once, each block into a partition.
    Repeated ids follow each other by hash and text; null ids stand last. Rows
    equal in both id and text are in one block.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("place", F.struct("doc_id", F.xxhash64("text").alias("h")))
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, min(most_blocks, size["bytes"] // block_bytes))
    every = max(1, size["n"] // (8 * blocks))
    sample = rows.where("doc_id is not null").where(F.pmod(F.xxhash64(F.lit("bounds"), "place"), F.lit(every)) == 0).select("place").distinct()
    places = sample.agg(F.sort_array(F.collect_list("place")).alias("places")).first()["places"]
    places = places[:: max(1, len(places) // blocks)]
    # Texts that Spark folds to arrays once, however many rows look into them.
    ids, hashes = (F.split(F.lit(",".join(str(x[c]) for x in places) or "0"), ",").cast("array<bigint>") for c in ("doc_id", "h"))
    doc_id, h = F.col("doc_id"), F.col("place.h")

    def upto(i: Column) -> Column:
        return (F.get(ids, i) < doc_id) | ((F.get(ids, i) == doc_id) & (F.get(hashes, i) <= h))

    steps = F.array(*[F.lit(1 << b) for b in range(len(places).bit_length(), -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda n, s: F.when(upto(n + s - 1), n + s).otherwise(n))
    without = F.floor((h / F.lit(2.0**64) + 0.5) * blocks).cast("int") - blocks - 1
    rows = rows.withColumn("block", F.when(doc_id.isNull(), without).otherwise(found))
    # The first row of each block; a row a block, so one window over all of them.
    heads = cut(rows.groupBy("block").agg(F.max("place").alias("head")))
    order = Window.orderBy(F.desc("block"))
    after = heads.select("block", F.coalesce(F.lead("block").over(order), F.max("block").over(Window.partitionBy())).alias("of"))
    texts = rows.join(F.broadcast(heads.withColumnRenamed("block", "of")), (F.col("block") == F.col("of")) & F.col("place").eqNullSafe(F.col("head")))
    texts = texts.groupBy("of").agg(F.max("text").alias("seam_text"))
    seam = cut(after.join(texts, "of").select("block", "seam_text"))
    parts = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, "block")
    return rows.select("doc_id", "text", "block", "place", F.lead("text").over(_following()).alias("next"), F.lead("block").over(_following()).alias("inside")), seam


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how like both and the next document's are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, seam = followed(docs)
    rows = fingerprint(rows, "text", "f").withColumn("after", F.lead("f").over(_following()))
    rows = rows.join(seam, "block", "left")
    lone = F.col("inside").isNull()
    third = F.floor(F.char_length("text") / 3).cast("int")
    follower = F.when(lone, F.col("seam_text")).otherwise(F.col("next"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - third), F.substring(follower, F.lit(1), third)))
    rows = fingerprint(rows, "edited", "g")
    rows = fingerprint(rows.withColumn("seam", F.when(lone, F.col("seam_text"))), "seam", "h")
    near = F.when(lone, F.col("h")).otherwise(F.col("after"))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("f")).alias("fingerprint"),
        shown(F.col("g")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("g")).alias("near_edited"),
        likeness(F.col("f"), near).alias("near_next"),
    )
