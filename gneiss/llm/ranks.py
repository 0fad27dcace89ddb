"""Running numbers within groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jobs import cut

#: Rows that a task numbers at once, about.
SLICE_ROWS = 1_000
#: Slices whose sums a task adds up at once.
SLICES = 1_000


def running(df: DataFrame, group: str, order: list[str], amount: str | None = None, rows: int | None = None) -> DataFrame:
    """Adds ``place``: how many rows (or how much of ``amount``) of the group stand before a row.

    Each group is dealt into slices by a hash of ``order``; slices follow one
    another, and rows within a slice follow ``order``. Slices are numbered by a
    window over their rows, and offset by windows over one row a slice and one a
    thousand slices. The
    number of slices grows with the rows, so a group may hold any share of them.
    Null ``amount`` counts as 0; rows that are equal in ``order`` get any of
    their places. ``df`` is read twice.
    """
    n = df.count() if rows is None else rows
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(max(1, -(-n // SLICE_ROWS)))))
    value = F.lit(1).cast("long") if amount is None else F.coalesce(F.col(amount).cast("long"), F.lit(0).cast("long"))
    sums = sliced.groupBy(group, "_slice").agg(F.sum(value).alias("_sum"))
    sums = cut(sums.select(F.col(group).alias("_group"), F.col("_slice").alias("_of"), F.floor(F.col("_slice") / SLICES).alias("_run"), "_sum"))

    def before(amount: str, *by: str, order: str):  # noqa: ANN202
        return F.coalesce(F.sum(amount).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    runs = sums.groupBy("_group", "_run").agg(F.sum("_sum").alias("_all")).select(F.col("_group").alias("_g"), F.col("_run").alias("_r"), before("_all", "_group", order="_run").alias("_base"))
    offsets = sums.withColumn("_offset", before("_sum", "_group", "_run", order="_of"))
    offsets = offsets.join(runs, offsets["_group"].eqNullSafe(F.col("_g")) & (F.col("_run") == F.col("_r")))
    offsets = cut(offsets.select("_group", "_of", (F.col("_offset") + F.col("_base")).alias("_offset")))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sliced.withColumn("_inside", inside)
    joined = placed.join(offsets, placed[group].eqNullSafe(F.col("_group")) & (F.col("_slice") == F.col("_of")))
    return joined.withColumn("place", F.col("_offset") + F.col("_inside")).drop("_slice", "_inside", "_group", "_of", "_offset")
