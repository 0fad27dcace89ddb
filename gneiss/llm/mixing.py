"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks of about the same size. With target
weight w, block j of a source is released at slot ``floor(j / w)`` and due by
slot ``ceil((j + 1) / w)``; the earliest deadline among released blocks gets
each slot. With weights that add up to one, every block meets its deadline, so
that at no time a source is a whole block away from its target.

Weights are exact: as decimals they are in the ratio of whole numbers, and after
as many slots as these add up to the schedule repeats. The slots of one such
frame (a table whose size does not depend on the data) give the slot of any
block in closed form. Only weights whose frame would be longer than
``Mix.frame`` are rounded to parts of that many; those are then the target. When
a source has no block left, the others go on at renormalised weights from the
next frame on: the schedule has a piece for each frame in which sources end, and
every block has a slot in one of them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import BROADCAST_ROWS, counted, cut, table
from .ranks import running

#: The name of slots while they stand beside a caller's own columns.
SLOT = "_gneiss_slot"


@dataclass(frozen=True)
class Mix:
    """Characters of a block, and slots of a frame at most.

    Where no weights are given a source weighs its size to the power ``power``,
    in whole parts of ``parts``, at least one.
    """

    block_chars: int = 50_000
    frame: int = 100_000
    parts: int = 1_000
    power: float = 0.7


def shares(weights: Mapping[str, float], frame: int) -> dict[str, int]:
    """Whole slots of the frame for each source, by largest remainder; at least one each.

    The frame grows to the number of sources if that is larger. Sources with a
    weight of 0 or less get none.
    """
    used = {s: float(w) for s, w in sorted(weights.items()) if w > 0}
    if not used:
        return {}
    frame, total = max(frame, len(used)), sum(used.values())
    ideal = {s: w / total * (frame - len(used)) for s, w in used.items()}
    out = {s: 1 + int(x) for s, x in ideal.items()}
    for s in sorted(used, key=lambda s: (int(ideal[s]) - ideal[s], s))[: frame - sum(out.values())]:
        out[s] += 1
    return out


def ratio(weights: Mapping[str, float], most: int) -> dict[str, int]:
    """The least whole numbers in the exact ratio of the weights, taken as decimals as they are written.

    If they add up to more than ``most``, the weights are rounded to parts of
    that many by :func:`shares`. Sources with a weight of 0 or less get none.
    """
    used = {s: Fraction(str(w)) for s, w in sorted(weights.items()) if w > 0}
    if not used:
        return {}
    unit = math.lcm(*(w.denominator for w in used.values()))
    whole = {s: int(w * unit) for s, w in used.items()}
    common = math.gcd(*whole.values())
    return {s: n // common for s, n in whole.items()} if sum(whole.values()) // common <= most else shares(weights, most)


def frame_slots(slots: Mapping[str, int]) -> dict[str, list[int]]:
    """The slots of one frame that each source gets, earliest deadline first."""
    frame = sum(slots.values())
    out: dict[str, list[int]] = {s: [] for s in slots}
    waiting = sorted((0, s) for s in slots)  # release, source
    ready: list[tuple[int, int, str]] = []  # deadline, share (larger first), source
    for t in range(frame):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            j, k = len(out[s]), slots[s]
            heapq.heappush(ready, (-(-(j + 1) * frame // k), -k, s))
        _, _, s = heapq.heappop(ready)
        out[s].append(t)
        if len(out[s]) < slots[s]:
            heapq.heappush(waiting, (len(out[s]) * frame // slots[s], s))
    return out


def segments(blocks: Mapping[str, int], weights: Mapping[str, float], how: Mix) -> Iterator[tuple[str, int, int, int, int, int, list[int]]]:
    """source, first block, block after the last, first slot, share, frame and slots within the frame, till no block is left.

    Whole frames repeat until a source has too few blocks for one. The frame in
    which sources end holds what they have left, and later blocks of it move up;
    the next one deals without them. All lists together are no longer than the
    blocks, and each source ends a piece at most once.
    """
    left, start = {s: n for s, n in blocks.items() if n > 0 and weights.get(s, 0) > 0}, 0
    done = dict.fromkeys(left, 0)
    while left:
        slots = ratio({s: weights[s] for s in left}, how.frame)
        frame, at = sum(slots.values()), frame_slots(slots)
        if whole := min(left[s] // k for s, k in slots.items()):
            for s, k in slots.items():
                yield s, done[s], done[s] + whole * k, start, k, frame, at[s]
                done[s], left[s] = done[s] + whole * k, left[s] - whole * k
            start += whole * frame
        if all(left.values()):
            held = {s: at[s][: left[s]] for s in slots}
            place = {t: i for i, t in enumerate(sorted(t for x in held.values() for t in x))}
            for s, x in held.items():
                yield s, done[s], done[s] + len(x), start, len(x), frame, [place[t] for t in x]
                done[s], left[s] = done[s] + len(x), left[s] - len(x)
            start += len(place)
        left = {s: n for s, n in left.items() if n}


def schedule(docs: DataFrame, weights: Mapping[str, float] | None = None, how: Mix = Mix(), source: str = "source", key: str = "doc_id", size: str = "n_chars") -> DataFrame:
    """key, source, block, slot and in_mix of each document.

    ``slot`` orders the blocks of all sources. Without ``weights`` they are the
    sources' sizes to ``how.power``; all documents are in the mix, and where a
    source ends the others go on at renormalised weights. With ``weights`` a mix
    of just these exists up to the slot at which the first source has no block
    left; ``in_mix`` tells the documents before it. Later documents keep their
    slots, and none is left out. Sources without a weight have a null slot and
    are not in the mix. A null source is a source of its own (the empty name), a
    null or negative size counts as 0. Repeated rows are documents each. Sources
    are taken to be few (their totals come to the driver, a row each); one may
    hold any share of the rows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    totals = {r["source"]: (r["n"], r["chars"]) for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars")).collect()}
    blocks = {s: max(0, chars - 1) // how.block_chars + 1 for s, (_, chars) in totals.items()}
    end = None
    if weights is None:
        pieces = list(segments(blocks, shares({s: max(chars, 1) ** how.power for s, (_, chars) in totals.items()}, how.parts), how))
    else:
        slots = ratio({s: w for s, w in weights.items() if s in totals}, how.frame)
        frame, per = sum(slots.values()), frame_slots(slots)
        pieces = [(s, 0, blocks[s], 0, k, frame, per[s]) for s, k in sorted(slots.items())]
        # A source's first slot without a block of its own ends the mix.
        end = min((blocks[s] // k * frame + per[s][blocks[s] % k] for s, k in slots.items()), default=0)
    spark = docs.sparkSession
    if not pieces:
        return rows.select("doc_id", "source", F.lit(0).cast("long").alias("block"), F.lit(None).cast("long").alias("slot"), F.lit(False).alias("in_mix"))
    plan = spark.createDataFrame(pieces, "of string, first long, after long, start long, share int, frame int, at array<int>")
    placed = running(rows, "source", ["doc_id", "size"], "size", rows=sum(n for n, _ in totals.values()))
    # A document that begins where its source ends (it has no characters) is of the last block.
    last = spark.createDataFrame([(s, b - 1) for s, b in sorted(blocks.items())], "source string, last long")
    out = placed.join(F.broadcast(last), "source").withColumn("block", F.least(F.floor(F.col("place") / how.block_chars).cast("long"), "last"))
    found = (F.col("source") == F.col("of")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("after"))
    out = out.join(F.broadcast(plan) if len(pieces) <= BROADCAST_ROWS else plan, found, "left")
    i = F.col("block") - F.col("first")
    slot = F.col("start") + F.floor(i / F.col("share")).cast("long") * F.col("frame") + F.get("at", F.pmod(i, F.col("share")).cast("int"))
    in_mix = F.col("slot").isNotNull() if end is None else F.coalesce(F.col("slot") < end, F.lit(False))
    return out.withColumn("slot", slot.cast("long")).select("doc_id", "source", "block", "slot", in_mix.alias("in_mix"))


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, how: Mix = Mix()) -> DataFrame:
    """The documents in the order of their slots; only ``weights`` given by the caller drop those beyond the mix.

    Rows of one doc_id stand together at their first slot, rows without a doc_id
    at the end (``weights`` drop them). Texts are shuffled once, for the order.
    """
    slots = schedule(docs.where("doc_id is not null"), weights, how).where("in_mix").groupBy("doc_id").agg(F.min("slot").alias(SLOT))
    placed = docs.join(counted(cut(slots)), "doc_id", "left" if weights is None else "inner")
    return placed.orderBy(F.col(SLOT).asc_nulls_last(), "doc_id").select(docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document in a mix of all documents whose sources weigh their size to the power 0.7."""
    return schedule(table(spark, sf_dir, "documents"))
