"""Packing documents into sequences: cutting stock by column generation.

A document is cut into full sequences and a rest. How many rests there are of
each length (in steps of ``quantum``) is all that the plan needs. A linear
program chooses how often to use which pattern of lengths; new patterns come
from a knapsack solved by dynamic programming over the program's prices, until
none improves the bound. It begins with the patterns of a greedy packing, so that
it ends early where those are good already. Whole parts of the solution become
sequences, what is left of the fractions is packed greedily, and slots are dealt
to the documents by their rank within their length. The plan's size depends on
the sequence length alone; the documents are numbered and joined by Spark.

Where the rows' order matters (a mix of sources), it is cut into spans of some
thousand sequences, and each span is planned and packed by itself, in tasks. No
sequence holds documents of two spans, and sequences are numbered in the order
of the first documents that they hold.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .jobs import counted, cut, map_rows, numbered, table, written
from .ranks import running
from .tokens import encoder


#: Rows of a file whose tokens are added up at once, and spans' plans are dealt over at most so many partitions.
SLICE_ROWS, PARTS = 100_000, 20_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@dataclass(frozen=True)
class Pack:
    """Tokens in a sequence and the step of lengths.

    The program stops within ``gap`` of its bound, or after ``rounds`` columns;
    :class:`Plan` tells the bound it has proved by then. ``span`` is about how
    many sequences are planned together where rows are packed in their order.
    """

    length: int = 4_096
    quantum: int = 4
    gap: float = 1e-3
    rounds: int = 10_000
    end_id: int = 2
    span: int = 2_048

    @property
    def classes(self) -> int:
        return -(-self.length // self.quantum)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_up(docs: DataFrame, how: Pack, path: str | None, kept: str = "") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: the pieces of each document; and the document's own columns ``kept`` (names with types)."""
    own = [c.split()[0] for c in kept.split(", ")] if kept else []

    def work(piece: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", *own)}
        for doc, ids, *more in zip(piece["doc_id"], encoder(path or vocabulary())(piece["text"]), *(piece[c] for c in own), strict=True):
            ids = np.append(ids, np.uint32(how.end_id)).astype("<u4")
            for start in range(0, len(ids), how.length):
                part = ids[start : start + how.length]
                for c, v in zip(out, (doc, start, len(part), zlib.crc32(part.tobytes()), len(ids), *more), strict=True):
                    out[c].append(v)
        return out

    return map_rows(docs.select("text", "doc_id", *own), work, f"{PIECE}, {kept}" if kept else PIECE)


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of lengths 1..len(prices) of a total of at most ``capacity``."""
    sizes = np.flatnonzero(prices > 0) + 1
    worth, fits = prices[sizes - 1], np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            values = worth[:k] + best[c - sizes[:k]]
            i = int(values.argmax())
            if values[i] > best[c]:
                best[c], choice[c] = values[i], sizes[i]
    pattern, c = np.zeros(len(prices)), capacity
    while c > 0:
        if choice[c]:
            pattern[choice[c] - 1] += 1
        c -= max(1, int(choice[c]))
    return float(best[capacity]), pattern


@dataclass(frozen=True)
class Plan:
    """Patterns (how many pieces of each length) and how often each is used; no packing has fewer sequences than ``bound``."""

    patterns: list[tuple[np.ndarray, int]]
    bound: float

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)


def greedy_basis(sizes: np.ndarray, capacity: int, demand: np.ndarray) -> np.ndarray:
    """A column for each length: longest first, each pattern used until one of its lengths runs out.

    Later columns do not hold the length that ran out, so they are independent.
    """
    left, open_ = demand.astype(float), np.ones(len(sizes), bool)
    columns = np.zeros((len(sizes), len(sizes)))
    for column in columns.T:
        room = capacity
        for k in np.flatnonzero(open_)[::-1]:
            if room >= sizes[k]:
                column[k] = room // sizes[k]
                room -= int(column[k]) * sizes[k]
        held = np.flatnonzero(column)
        out = held[(left[held] / column[held]).argmin()]
        left = np.maximum(left - left[out] / column[out] * column, 0)
        open_[out] = False
    return columns


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan steps with row pivots.

    Written out because the threads of a BLAS library may hang in a process that
    has forked, as a Spark driver does to start its JVM.
    """
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        pivot = i + int(np.abs(both[i:, i]).argmax())
        if pivot != i:
            both[[i, pivot]] = both[[pivot, i]]
        both[i] /= both[i, i]
        rows = np.flatnonzero(both[:, i])
        rows = rows[rows != i]
        both[rows] -= both[rows, i, None] * both[i]
    return both[:, n:].copy()


def relaxed(demand: np.ndarray, gap: float, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Columns over the lengths in demand, how often each is used (fractions), and a lower bound of their sum.

    Prices over the value of the best pattern are a feasible dual solution, so
    their sum over the demand is a bound. New columns are priced between the
    best such prices and the present ones, which steadies the program.
    """
    capacity, need = len(demand), np.flatnonzero(demand)
    sizes, d = need + 1, demand[need].astype(float)
    basis = greedy_basis(sizes, capacity, d)
    inverse = inverted(basis)
    x = np.maximum(inverse @ d, 0)
    bound, best = float(d @ sizes) / capacity, None
    for step in range(rounds):
        duals = inverse.sum(axis=0)
        column = None
        for share in (0.7, 0.0) if best is not None else (0.0,):
            p = np.maximum(duals, 0) * (1 - share) + (best * share if share else 0)
            prices = np.zeros(capacity)
            prices[need] = p
            value, pattern = knapsack(prices, capacity)
            low = float(d @ p) / value
            if best is None or low > bound:
                bound, best = max(bound, low), p / value
            if pattern[need] @ duals > 1 + 1e-9:
                column = pattern[need]
                break
        if column is None or x.sum() <= bound * (1 + gap):
            break
        change = inverse @ column
        leave = int(np.where(change > 1e-9, x / np.where(change > 1e-9, change, 1), np.inf).argmin())
        basis[:, leave] = column
        row = inverse[leave] / change[leave]
        inverse -= np.outer(change, row)
        inverse[leave] = row
        if step % 100 == 99:
            inverse = inverted(basis)
        x = np.maximum(inverse @ d, 0)
    return basis, x, bound


def greedily(left: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Longest first, into what fits; each pattern as often as its pieces last."""
    capacity, left, out = len(left), left.copy(), []
    while left.any():
        counts, room = np.zeros(capacity, np.int64), capacity
        for k in np.flatnonzero(left)[::-1]:
            n = min(int(left[k]), room // (int(k) + 1))
            counts[k], room = n, room - n * (int(k) + 1)
        held = counts > 0
        times = int((left[held] // counts[held]).min())
        left -= times * counts
        out.append((counts, times))
    return out


def plan(demand: np.ndarray, gap: float = 1e-3, rounds: int = 10_000) -> Plan:
    """Patterns that cover the demand exactly: the rounded program, or the greedy packing where that is no longer.

    ``demand[k]`` counts the pieces of length k + 1; the capacity is the number of lengths.
    """
    capacity, need = len(demand), np.flatnonzero(demand)
    if not len(need):
        return Plan([], 0.0)
    basis, x, bound = relaxed(demand, gap, rounds)
    chosen: list[tuple[np.ndarray, int]] = []
    left = demand.astype(np.int64)
    for i in np.argsort(-x, kind="stable"):
        counts = np.zeros(capacity, np.int64)
        counts[need] = np.round(basis[:, i]).astype(np.int64)
        held = counts > 0
        times = min(int(x[i] + 1e-7), int((left[held] // counts[held]).min()))
        if times > 0:
            left = left - times * counts
            chosen.append((counts, times))
    rounded, plain = Plan(chosen + greedily(left), bound), Plan(greedily(demand.astype(np.int64)), bound)
    return min(rounded, plain, key=lambda p: p.sequences)


def slots(patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length class, first rank, end rank, ranks a sequence, first sequence) of each pattern's use of a class."""
    out, used, first = [], {}, 0
    for counts, times in patterns:
        for k in np.flatnonzero(counts):
            start, per = used.get(int(k), 0), int(counts[k])
            out.append((int(k) + 1, start, start + per * times, per, first))
            used[int(k)] = start + per * times
        first += times
    return out


def pack(docs: DataFrame, how: Pack = Pack(), path: str | None = None) -> DataFrame:
    """A row for each piece: its document, its ids' place and checksum, its sequence and offset.

    Null and empty texts have the end id alone. Repeated rows are documents
    each. A row with a null doc_id is packed like any other. Other columns are
    not looked at. Texts are tokenized once; only the pieces' numbers are
    written and shuffled. ``path`` is the tokenizer's file.
    """
    pieces = written(cut_up(docs, how, path).withColumn("class", F.ceil(F.col("length") / how.quantum).cast("int")))
    counts = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    demand = np.array([counts.get(k + 1, 0) for k in range(how.classes)], np.int64)
    deal = docs.sparkSession.createDataFrame(slots(plan(demand, how.gap, how.rounds).patterns), "class int, first long, last long, per long, base long")
    ranked = running(pieces, "class", ["doc_id", "start", "ids_crc32"], rows=int(demand.sum()))
    ranked = ranked.withColumnRenamed("class", "own")
    placed = ranked.join(F.broadcast(deal), (F.col("own") == F.col("class")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("last")))  # at most some thousand rows
    placed = placed.withColumn("sequence_id", (F.col("base") + F.floor((F.col("place") - F.col("first")) / F.col("per"))).cast("long"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "place").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))


def spanned(pieces: DataFrame, how: Pack) -> tuple[DataFrame, int]:
    """Adds ``at``, how many tokens stand before a piece, and ``span``; and the number of spans, which have about the same tokens each."""
    sliced = pieces.withColumn("_slice", F.floor(F.col("_row") / SLICE_ROWS))
    sums = cut(sliced.groupBy("_file", "_slice").agg(F.sum("length").alias("_sum")))
    total = sums.agg(F.sum("_sum")).first()[0] or 0
    spans = max(1, round(total / (how.span * how.length)))
    before = lambda amount, w: F.coalesce(F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One task adds up a row for each file and each hundred thousand rows of it.
    bases = sums.withColumn("_base", before("_sum", Window.orderBy(F.length("_file"), "_file", "_slice"))).select(F.col("_file").alias("_f"), F.col("_slice").alias("_s"), "_base")
    inside = sliced.withColumn("_inside", before("length", Window.partitionBy("_file", "_slice").orderBy("_row", "start")))
    placed = inside.join(bases, (F.col("_file") == F.col("_f")) & (F.col("_slice") == F.col("_s"))).withColumn("at", F.col("_base") + F.col("_inside"))
    width = max(1, -(-total // spans))
    return placed.withColumn("span", F.floor(F.col("at") / width)).drop("_file", "_row", "_slice", "_inside", "_f", "_s", "_base"), spans


def pack_in_order(docs: DataFrame, how: Pack = Pack(), path: str | None = None) -> DataFrame:
    """As :func:`pack`, but sequences follow the order of the rows (see :func:`jobs.numbered`), span by span.

    Within a span the rows of each length are dealt in their order, sequences
    are numbered by the first row that they hold, and their pieces stand in order.
    """
    pieces = cut_up(numbered(docs.select("text", "doc_id")), how, path, "_file string, _row long")
    placed, spans = spanned(written(pieces), how)
    placed = written(placed.withColumn("class", F.ceil(F.col("length") / how.quantum).cast("int")))

    def planned(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        demand = np.zeros(how.classes, np.int64)
        demand[rows["class"].to_numpy() - 1] = rows["n"]
        made, uses = plan(demand, how.gap, how.rounds), {}
        for size, first, last, per, base in slots(made.patterns):
            uses.setdefault(size, []).append({"first": first, "last": last, "per": per, "base": base})
        return pd.DataFrame({"in_span": key[0], "of": list(uses), "sequences": made.sequences, "uses": list(uses.values())})

    use = "in_span long, of int, sequences long, uses array<struct<first: long, last: long, per: long, base: long>>"
    demands = placed.groupBy("span", "class").agg(F.count(F.lit(1)).alias("n"))
    deal = written(demands.repartition(min(PARTS, 2 * spans), "span").groupBy("span").applyInPandas(planned, use))
    rank = F.row_number().over(Window.partitionBy("span", "class").orderBy("at")) - 1
    dealt = placed.withColumn("place", rank).join(deal, (F.col("span") == F.col("in_span")) & (F.col("class") == F.col("of")))
    used = F.filter("uses", lambda u: (F.col("place") >= u["first"]) & (F.col("place") < u["last"]))[0]
    dealt = dealt.withColumn("use", used).withColumn("local", (F.col("use.base") + F.floor((F.col("place") - F.col("use.first")) / F.col("use.per"))).cast("long")).drop("uses", "use")
    same = Window.partitionBy("span", "local")
    offset = F.coalesce(F.sum("length").over(same.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    held = dealt.select("*", offset.alias("offset"), F.min("at").over(same).alias("head"))
    held = held.withColumn("nth", F.dense_rank().over(Window.partitionBy("span").orderBy("head")) - 1)
    bases = deal.groupBy("in_span").agg(F.max("sequences").alias("n"))  # a row a span
    bases = cut(bases.select(F.col("in_span").alias("_span"), F.coalesce(F.sum("n").over(Window.orderBy("in_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base")))
    joined = held.join(counted(bases), F.col("span") == F.col("_span"))
    return joined.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_base") + F.col("nth")).cast("long").alias("sequence_id"), "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4,096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
