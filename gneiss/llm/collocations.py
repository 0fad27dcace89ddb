"""Phrase collocation mining: Apriori passes, level by level, and the worst cut of each phrase.

A pass over the texts counts the phrases of one length. A phrase of k words is
counted only where both phrases of k-1 words in it are frequent. What is
frequent reaches the tasks as a filter of fixed size, a bit for a hash, that is
broadcast at every size of input: an entry too many costs a count, which the
threshold on true counts drops again, and none is missing. Counts are of words
themselves, never of hashes; they are combined in each task and before the
shuffle, so a phrase may hold any share of all words.

The tables of all levels then give the counts of both parts of each cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .jobs import arrow_schema, map_batches, table, written
from .words import hashed

#: Bytes of the filter of frequent phrases that one row holds.
CHUNK = 1 << 16
#: Slices of a language in which first places are sought before all of it is ranked.
SLICES = 64
#: Bytes of text counted at once: the more, the more counts are combined.
BYTES = 6_000_000
#: A-Z in lower case, ends of pieces as full stops, tabs as spaces.
_FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz.......... ")


@dataclass(frozen=True)
class Mining:
    """Most words in a phrase, least count, percentage of the count at which a longer phrase replaces it, phrases a language.

    The filter of frequent phrases has ``2**filter_bits`` bits (8 MB), 19 at least.
    """

    words: int = 4
    least: int = 30
    share: int = 80
    first: int = 2_000
    filter_bits: int = 26


def numbered(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The number of each word of the texts on end, 0 between pieces and texts; and the words by number."""
    data = b".".join([b"", *texts, b""]).translate(_FOLDED).replace(b".", b" . ")
    inside = np.frombuffer(data, np.uint8) != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    at = np.zeros(len(edges) // 2 + 1, np.int32)
    np.cumsum(edges[1::2] - edges[0::2], out=at[1:])
    words = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data.translate(None, b" "))]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary


def places(phrases: pa.Array, lang: str, size: int) -> np.ndarray:
    """Places of a language's phrases in a filter of ``size`` bytes."""
    at = np.frombuffer(phrases.buffers()[1], np.int32)[phrases.offset : phrases.offset + len(phrases) + 1].astype(np.int64)
    data = phrases.buffers()[2]
    seed = np.uint64(xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))
    return ((hashed(data.to_pybytes() if data else b"", at[:-1], at[1:]) ^ seed) & np.uint64(8 * size - 1)).astype(np.int64)


def passing(phrases: pa.Array, lang: str, held: np.ndarray) -> np.ndarray:
    at = places(phrases, lang, len(held))
    return (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def counts(texts: list[bytes], lang: str, k: int, filters: list[np.ndarray]) -> tuple[pa.Array, np.ndarray, int]:
    """Phrases of k words in texts of one language that filters of levels 1 to k-1 let pass, their counts, and all words.

    Phrases are numbered by pairs of the shorter phrase's number and the last
    word's, so what is counted are the words themselves.
    """
    words, names = numbered(texts)
    total = int(np.count_nonzero(words))
    if k == 1:
        return names.slice(1), np.bincount(words, minlength=len(names))[1:], total
    # From each place on, ``gram`` numbers the phrase of ``level`` words; ``ok`` tells whether it may be frequent.
    gram, phrases, which = words, names, words
    ok = np.concatenate([[False], passing(names.slice(1), lang, filters[0])])[words]
    for level in range(2, k + 1):
        n = max(0, len(words) - level + 1)
        at = np.flatnonzero(ok[:n] & ok[1 : n + 1])
        pairs = pa.array((gram[at] << 32) | words[at + level - 1]).dictionary_encode()
        which, pairs = pairs.indices.to_numpy(), pairs.dictionary.to_numpy()
        phrases = pc.binary_join_element_wise(phrases.take(pa.array(pairs >> 32)), names.take(pa.array(pairs & 0xFFFFFFFF)), b" ")
        if level < k:
            gram, ok = np.zeros(n, np.int64), np.zeros(n, bool)
            gram[at], ok[at] = which, passing(phrases, lang, filters[level - 1])[which]
    return phrases, np.bincount(which, minlength=len(phrases)), total


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they have enough bytes to be counted at once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_lang(table: pa.Table) -> Iterator[tuple[str, pa.Table]]:
    for lang in pc.unique(table.column("lang")).to_pylist():
        yield lang, table.filter(pc.equal(table.column("lang"), lang))


def counted_level(docs: DataFrame, k: int, filters: list, how: Mining) -> DataFrame:  # noqa: ANN001
    """lang, phrase, f: phrases of k words that occur often enough; at level 1 also a row a language with null phrase and all words."""
    ddl = "lang string, phrase string, f long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [f.value for f in filters]
        for table in gathered(batches):
            for lang, rows in by_lang(table):
                phrases, f, total = counts(rows.column("text").drop_null().cast(pa.binary()).to_pylist(), lang, k, held)
                names = phrases.cast(pa.string())
                if k == 1:
                    names, f = pa.concat_arrays([names, pa.nulls(1, pa.string())]), np.append(f, total)
                yield from pa.table([pa.array([lang] * len(names), pa.string()), names, pa.array(f, pa.int64())], schema=schema).to_batches(max_chunksize=50_000)
            pa.default_memory_pool().release_unused()

    every = map_batches(docs, run, ddl).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return written(every.where((F.col("f") >= how.least) | F.col("phrase").isNull()))


def filter_of(level: DataFrame, how: Mining):  # noqa: ANN201
    """The broadcast filter of a level's phrases: parts of fixed size are put together in tasks."""
    size = (1 << how.filter_bits) >> 3
    ddl = "chunk int, bits binary"
    schema = arrow_schema(ddl)

    def merge(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, part in of(b):
                held[chunk] = held[chunk] | part if chunk in held else part
        for chunk, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part.tobytes()], pa.binary())], schema=schema)

    def marked(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        rows = by_lang(pa.Table.from_batches([b]))
        at = np.concatenate([np.zeros(0, np.int64), *(places(part.column("phrase").combine_chunks().cast(pa.binary()), lang, size) for lang, part in rows)])
        for chunk in np.unique(at // (CHUNK * 8)).tolist():
            bits = np.zeros(CHUNK * 8, np.uint8)
            bits[at[at // (CHUNK * 8) == chunk] % (CHUNK * 8)] = 1
            yield chunk, np.packbits(bits, bitorder="little")

    def read(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        return ((c, np.frombuffer(v.as_buffer(), np.uint8)) for c, v in zip(b.column(0).to_pylist(), b.column(1), strict=True))

    parts = map_batches(level.where("phrase is not null").select("lang", "phrase"), lambda bs: merge(bs, marked), ddl)
    whole = np.zeros(size, np.uint8)
    for chunk, bits in map_batches(parts.repartition(16, "chunk"), lambda bs: merge(bs, read), ddl).collect():
        whole[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(bits, np.uint8)
    return level.sparkSession.sparkContext.broadcast(whole)


def levels(docs: DataFrame, how: Mining) -> list[DataFrame]:
    """The tables of frequent phrases of 1, 2, ... words."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    out, filters = [], []
    for k in range(1, how.words + 1):
        if k > 1:
            filters.append(filter_of(out[-1], how))
        out.append(counted_level(rows, k, filters, how))
    return out


def scored(tables: list[DataFrame], how: Mining) -> DataFrame:
    """lang, phrase, words, a, l, r, score: each candidate with its lowest-scoring cut."""
    every = tables[0].where("phrase is not null")
    for t in tables[1:]:
        every = every.unionByName(t)
    longer = tables[1]
    for t in tables[2:]:
        longer = longer.unionByName(t)
    words = F.split("phrase", " ", -1)
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), words.alias("w")).select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"))
    head = every.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tail = every.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    both = cuts.join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
    # Whole numbers of 38 digits: two million times a count may pass 64 bits.
    score = F.expr("cast(cast(2000000 as decimal(38, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as bigint)")
    best = both.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("c")).groupBy("lang", "phrase", "a").agg(F.min("c").alias("c"))
    return best.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))


def replaced(tables: list[DataFrame]) -> DataFrame:
    """lang, phrase, longest: of phrases that lie in a longer candidate, the count of the most frequent such one."""
    inner = None
    for length, t in enumerate(tables[1:], 2):
        if length > 2:
            words = F.split("phrase", " ", -1)
            parts = [F.array_join(F.slice(words, i, n), " ") for n in range(2, length) for i in range(1, length - n + 2)]
            rows = t.select("lang", F.explode(F.array(*parts)).alias("phrase"), "f")
            inner = rows if inner is None else inner.unionByName(rows)
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("longest")) if inner is not None else tables[0].where("false").select("lang", "phrase", F.col("f").alias("longest"))


def mine(docs: DataFrame, how: Mining = Mining()) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A null language is ``und``; null and empty texts have no words. Repeated
    rows count as often as they stand there. Ties are settled by count, then by
    the bytes of the phrase. Without candidates the result is empty. Other
    columns are not looked at.
    """
    tables = levels(docs, how)
    best = scored(tables, how)
    kept = best.join(replaced(tables), ["lang", "phrase"], "left").where(F.coalesce("longest", F.lit(0)).cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * how.share)
    kept = kept.drop("longest").withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = kept.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(F.col("_place") <= how.first)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= how.first)
    n = tables[0].where("phrase is null").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of 2 to 4 words of each language."""
    return mine(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with d as (select row_number() over () as i, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select i, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as t from d),
w as (select lang, list_filter(regexp_split_to_array(t, '[\x20\x09]+'), lambda x: x <> '') as w from p),
g as (select lang, k, array_to_string(w[s:s + k - 1], ' ') as phrase
      from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as s from w, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k)),
f as (select lang, k, phrase, count(*) as f from g group by all),
n as (select lang, sum(f)::BIGINT as n from f where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 30),
x as (select lang, phrase, a, j, array_to_string(w[1:j], ' ') as head, array_to_string(w[j + 1:], ' ') as tail from (select *, unnest(range(1, k)) as j from c)),
s as (select x.lang, x.phrase, x.a, x.j, h.f as l, t.f as r, ((2000000::HUGEINT * x.a) // (h.f + t.f))::BIGINT as score
      from x join f h on h.lang = x.lang and h.phrase = x.head and h.k = x.j join f t on t.lang = x.lang and t.phrase = x.tail),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
u as (select lang, array_to_string(w[o:o + m - 1], ' ') as phrase, a from (select lang, w, a, m, unnest(range(1, k - m + 2)) as o from c, (select unnest([2, 3]) as m) where k > m)),
v as (select lang, phrase, max(a) as longest from u group by all),
k as (select b.* from b left join v using (lang, phrase) where 100 * coalesce(longest, 0) < 80 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from k join n using (lang) qualify rank <= 2000
"""
