"""N-gram Jaccard join: grouped prefix join over word shingles, exact at any size.

Two sets whose Jaccard index reaches the threshold share a token among the
first ``n - ceil(t * n) + 1`` tokens of each in any common order (the prefix).
Tokens are ordered by how often they occur, rare ones first; occurrences are
counted over all documents in a sketch of fixed size, whose errors cost time
but lose nothing. Documents with equal sets are one member; members with equal
prefix and size are one group, which stands once in the inverted lists.

Links are needed up to connectivity. So each member is first held against one
pivot, the least member that a list has in common with it: no more pairs than
members. Components
of what is linked are then known, and only pairs of a list that lie in
different components and pass the size and position filters are expanded to
members and verified. Before sets are fetched, a few bits of each set bound
from below in how many tokens a pair differs, which rules most pairs out. Pairs within a component are never listed, which is what
keeps groups of near copies from growing with their square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .jobs import arrow_schema, counted, cut, map_batches, map_rows, pieces, table
from .words import Ranges, batch, starts

SKETCH_BITS = 20
CHUNK = 4_096


@dataclass(frozen=True)
class Likeness:
    """Words in a shingle, and the least Jaccard index of a link as ``num / den``."""

    shingle: int = 5
    num: int = 80
    den: int = 100


def shingles(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; fewer than k words make one; none make none."""
    words, bounds = batch(texts, lower=True)
    ranges, at = Ranges(words), starts(bounds, k)
    hashes = ranges.of(at, at + k)
    cuts = np.searchsorted(at, bounds)
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < k))
    out = [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for i, h in zip(short, ranges.of(bounds[short], bounds[short + 1]), strict=True):
        out[i] = np.array([h], np.uint64)
    return out


def sketch(docs: DataFrame, how: Likeness) -> np.ndarray:
    """How often tokens occur, by the first bits of their hash: a level for each of 2**SKETCH_BITS buckets.

    Counts are added up in each task and sent in fixed chunks; what reaches the
    driver has a fixed size (2 MB), whatever the input.
    """
    size, k = 1 << SKETCH_BITS, how.shingle
    ddl = "chunk int, counts binary"
    schema = arrow_schema(ddl)

    def emit(held: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, size, CHUNK):
            if held[i : i + CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK], pa.int32()), pa.array([held[i : i + CHUNK].tobytes()], pa.binary())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.uint32)
        for piece in pieces(batches, "text"):
            tokens = np.concatenate([*shingles(piece["text"], k), np.zeros(0, np.uint64)])
            held += np.bincount((tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size).astype(np.uint32)
        yield from emit(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n = np.frombuffer(counts.as_buffer(), np.uint32).astype(np.float64)
                held[chunk] = held[chunk] + n if chunk in held else n
        for chunk, n in held.items():
            level = np.round(np.log2(n + 1) * 1024).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([level.tobytes()], pa.binary())], schema=schema)

    levels = np.zeros(size, np.uint16)
    for chunk, counts in map_batches(map_batches(docs.select("text"), count, ddl).repartition(16, "chunk"), add, ddl).collect():
        levels[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(counts, np.uint16)
    return levels


def prefixes(docs: DataFrame, how: Likeness) -> DataFrame:
    """doc_id, n (tokens), set_id, group_id (equal prefix and size), prefix in order of frequency."""
    levels = docs.sparkSession.sparkContext.broadcast(sketch(docs, how))
    shift = np.uint64(64 - SKETCH_BITS)

    def work(piece: dict[str, list]) -> dict[str, list]:
        n, sets, groups, prefix, odd = [], [], [], [], []
        for s in shingles(piece["text"], how.shingle):
            keep = len(s) - -(-how.num * len(s) // how.den) + 1 if len(s) else 0
            key = (levels.value[(s >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(48)) | (s >> np.uint64(16))
            first = s[np.argsort(key, kind="stable")[:keep]]
            n.append(len(s))
            sets.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            groups.append(hashlib.blake2b(first.tobytes() + len(s).to_bytes(8, "big"), digest_size=16).digest())
            prefix.append(first.view(np.int64))
            odd.append(parity(s))
        return {"doc_id": piece["doc_id"], "n": n, "set_id": sets, "group_id": groups, "prefix": prefix, "odd": odd}

    return map_rows(docs.select("doc_id", "text"), work, "doc_id long, n int, set_id binary, group_id binary, prefix array<long>, odd binary")


def parity(tokens: np.ndarray) -> bytes:
    """Bits that each token flips, two to four for a token: a sixteenth of the set's size at most."""
    bits = 1 << max(6, (2 * len(tokens)).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """How many bits differ: never more than the sets have tokens that are in one of them only."""
    a, b = sorted((np.unpackbits(np.frombuffer(v, np.uint8)) for v in (x, y)), key=len)
    return int(np.count_nonzero(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)))


def sift(pairs: DataFrame, rows: DataFrame, how: Likeness) -> DataFrame:
    """Leaves out pairs (a, b) that differ in too many bits to be linked; loses none that is."""
    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    marks = rows.select("doc_id", "n", "odd").join(counted(ids), "doc_id", "left_semi")
    num, den = how.num, how.den

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.to_pydict()
            ok = [(den + num) * differing(x, y) <= (den - num) * (n + m) for x, y, n, m in zip(c["x"], c["y"], c["n"], c["m"], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = marks.alias("x"), marks.alias("y")
    with_b = pairs.join(y, F.col("b") == F.col("y.doc_id")).select("a", "b", F.col("n").alias("m"), F.col("odd").alias("y"))
    both = with_b.join(x, F.col("a") == F.col("x.doc_id")).select("a", "b", "n", "m", F.col("odd").alias("x"), "y")
    return cut(map_batches(both, near, "a long, b long"))


def verify(pairs: DataFrame, docs: DataFrame, how: Likeness) -> DataFrame:
    """The pairs (a, b) of document ids whose sets reach the threshold, compared exactly."""
    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    k, num, den = how.shingle, how.num, how.den

    def hashed(piece: dict[str, list]) -> dict[str, list]:
        return {"doc_id": piece["doc_id"], "tokens": [s.tobytes() for s in shingles(piece["text"], k)]}

    sets = map_rows(docs.select("doc_id", "text").join(counted(ids), "doc_id", "left_semi"), hashed, "doc_id long, tokens binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    x, y = sets.alias("x"), sets.alias("y")
    with_b = pairs.join(y, F.col("b") == F.col("y.doc_id")).select("a", "b", F.col("tokens").alias("y"))
    both = with_b.join(x, F.col("a") == F.col("x.doc_id")).select("a", "b", F.col("tokens").alias("x"), "y")
    return map_batches(both, compare, "a long, b long")


def _fits(n: str, at: str, m: str, to: str, how: Likeness):  # noqa: ANN202
    """Can sets of n and m tokens that first meet at positions at and to still be linked?"""
    n, at, m, to = (F.col(c).cast("long") for c in (n, at, m, to))
    need = F.ceil(how.num * (n + m) / F.lit(float(how.num + how.den)) - 1e-9)
    return (how.den * F.least(n, m) >= how.num * F.greatest(n, m)) & (F.least(n - at, m - to) >= need)


def join(docs: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id.

    ``component_id`` is the least doc_id that links lead to, the document itself
    included. Texts without words, empty and null ones have no shingles and link
    with nothing, not with each other either. Equal sets are linked. Repeated
    rows give repeated results; rows with a null doc_id link with nothing.
    Other columns are not looked at.
    """
    rows = cut(prefixes(docs, how))
    members = cut(rows.where("n > 0 and doc_id is not null").groupBy("set_id", "group_id", "n").agg(F.min("doc_id").alias("id")))
    heads = cut(members.groupBy("group_id").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("size")))
    # Inverted lists over group heads; tokens that only one group has are of no use.
    first = rows.join(heads.select(F.col("head").alias("doc_id")), "doc_id", "left_semi")
    entries = first.select(F.col("doc_id").alias("head"), "n", F.posexplode("prefix").alias("at", "token"))
    shared = cut(entries.groupBy("token").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1").select("token"))
    lists = cut(entries.join(shared, "token"))
    pivots = cut(lists.groupBy("token").agg(F.min(F.struct("head", "n", "at")).alias("p")).select("token", F.col("p.head").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.at").alias("pivot_at")))
    stars = lists.join(pivots, "token").where(F.col("head") > F.col("pivot")).where(_fits("n", "at", "pivot_n", "pivot_at", how)).groupBy("head").agg(F.min("pivot").alias("a")).select("a", F.col("head").alias("b"))
    grouped = cut(members.join(heads.where("size > 1").drop("size"), "group_id").select("id", "head", "n"))
    inside = grouped.where("id > head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    tried = cut(stars.unionByName(inside).distinct())
    near = cut(verify(sift(tried, rows, how), docs, how))
    found = components(near)
    # What the stars left open: pairs of a list in different components.
    known = counted(found)
    wide = lists.join(counted(grouped.select("head", F.col("id").alias("other"))), "head", "left")
    within = grouped.join(grouped.groupBy("head").agg(F.count(F.lit(1)).alias("s")).where("s > 2"), "head").select("head", F.col("head").alias("token"), F.lit(1).alias("kind"), "id", "n", F.lit(0).alias("at"), F.col("head").alias("pivot"))
    entered = wide.join(pivots.select("token", "pivot"), "token").select("head", "token", F.lit(0).alias("kind"), F.coalesce("other", "head").alias("id"), "n", "at", "pivot").unionByName(within)
    placed = entered.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    of_pivot = found.select(F.col("id").alias("pivot"), F.col("component").alias("pivot_component"))
    placed = cut(placed.join(counted(of_pivot), "pivot", "left").withColumn("pivot_component", F.coalesce("pivot_component", "pivot")))
    x = placed.where("component <> pivot_component").select("token", "kind", "head", "pivot", *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "at", "component")])
    y = placed.select("token", "kind", *[F.col(c).alias(f"y_{c}") for c in ("id", "n", "at", "component")])
    open_ = x.join(y, ["token", "kind"]).where(F.col("x_component") != F.col("y_component")).where(_fits("x_n", "x_at", "y_n", "y_at", how))
    rest = open_.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
    rest = cut(rest.join(counted(tried), ["a", "b"], "left_anti"))
    more = cut(verify(sift(rest, rows, how), docs, how))
    if more.limit(1).count():
        lead = found.select(F.col("id").alias("v"), "component")
        ends = more.join(lead, F.col("a") == F.col("v"), "left").select(F.coalesce("component", "a").alias("a"), "b").join(lead, F.col("b") == F.col("v"), "left").select("a", F.coalesce("component", "b").alias("b"))
        joined = components(ends)
        every = found.select("id", F.col("component").alias("c")).unionByName(joined.select("id", F.col("id").alias("c"))).distinct()
        found = every.join(joined.select(F.col("id").alias("c"), "component"), "c", "left").groupBy("id").agg(F.min(F.coalesce("component", "c")).alias("component"))
    final = members.join(found, "id", "left").select("set_id", F.coalesce("component", "id").alias("component_id"))
    out = rows.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id")).join(final, "set_id", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """The documents that are the least of their component; of repeated rows one stays."""
    keep = cut(join(docs, how).where("doc_id = component_id or doc_id is null").select("doc_id").distinct())
    kept = docs.join(counted(keep.where("doc_id is not null")), "doc_id", "left_semi")
    twice = counted(cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 and doc_id is not null").select("doc_id")))
    once, again = kept.join(twice, "doc_id", "left_anti"), kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.select(docs.columns).unionByName(again.select(docs.columns)).unionByName(docs.where("doc_id is null"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 90 % of their 3-word shingles."""
    return join(table(spark, sf_dir, "documents"), Likeness(3, 90, 100))


OP9_SQL = r"""
with t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as g from t),
n as (select doc_id, len(g)::BIGINT as n_shingles from s),
e as (select doc_id, unnest(g) as k from s),
f as (select k from e group by k having count(*) > 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as common from e a join f using (k) join e b on a.k = b.k and a.doc_id < b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 90 * (x.n_shingles + y.n_shingles - common)),
m as (select a, b from l union all select b, a from l),
r as (with recursive r(v, u) as (select doc_id, doc_id from documents union select r.v, m.b from r join m on m.a = r.u)
      select v, min(u) as u from r group by v)
select n.doc_id, n.n_shingles, r.u as component_id from n join r on r.v = n.doc_id
"""
