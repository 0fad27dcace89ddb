"""Drawing references: child rows get a whole parent row each, by number.

Row r of a child takes parent ``(r div stride) mod n``. With the product of the
sizes before it as stride, several references together run through all pairs
before one comes back (an odometer), which is what a join table's key needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def parent_row(row: Column, parents: int, stride: int = 1) -> Column:
    return F.pmod(F.floor(row / F.lit(stride)).cast("long"), F.lit(parents))


def numbered(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """Adds a number from 0 without gaps in the given order.

    Rows are sorted by range; numbers run within a range and are offset by the
    counts of the ranges before it, so no task sees more than its range. The
    ranges are fixed by a checkpoint before they are counted.
    """
    sliced = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = sliced.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(counts.select("_range", before.alias("_before")))  # a row a partition
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return sliced.withColumn("_inside", inside).join(offsets, "_range").withColumn(name, (F.col("_before") + F.col("_inside") - 1).cast("long")).drop("_range", "_inside", "_before")


def drawn(child: DataFrame, parents: DataFrame, n: int, columns: dict[str, str], row: str = "row", stride: int = 1) -> DataFrame:
    """The child with the parent's columns under new names; ``parents`` has ``row`` from 0 to n - 1.

    An equi-join on the parent's number; Spark broadcasts the keys if they are small.
    """
    keys = parents.select(F.col("row").alias("_parent"), *[F.col(k).alias(c) for c, k in columns.items()])
    return child.withColumn("_parent", parent_row(F.col(row), n, stride)).join(keys, "_parent", "left").drop("_parent")


def strides(sizes: list[int]) -> list[int]:
    """The stride of each wheel of an odometer with these sizes."""
    out, product = [], 1
    for n in sizes:
        out.append(product)
        product *= max(1, n)
    return out


def rooted(df: DataFrame, key: str, reference: str) -> DataFrame:
    """A hierarchy with one root: the least key refers to none, all others to it."""
    least = df.agg(F.min(key).alias("_least"))
    return df.crossJoin(F.broadcast(least)).withColumn(reference, F.when(F.col(key) != F.col("_least"), F.col("_least"))).drop("_least")  # one row


def within(df: DataFrame, shared: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with ``_local``, their number from 0 within each value of ``shared``; and (shared, ``_rows``), how many each value has.

    Rows are numbered over all of the table in the order of shared and own
    columns; a table of offsets, one row a value, takes that to numbers within
    the value. So no value, however many rows it has, is numbered in one task.
    """
    known = df.where(" and ".join(f"`{c}` is not null" for c in shared))
    rows = cut(numbered(known, [*shared, *order], "_number"))
    sizes = cut(rows.groupBy(*shared).agg(F.min("_number").alias("_from"), F.count(F.lit(1)).alias("_rows")))
    return rows.join(sizes, shared).withColumn("_local", F.col("_number") - F.col("_from")).drop("_number", "_from", "_rows"), sizes.drop("_from")


def drawn_shared(child: DataFrame, first: DataFrame, second: DataFrame, shared: list[str], keys: tuple[list[str], list[str]], row: str = "row") -> DataFrame:
    """The child with a row of each of two parents that agree on the ``shared`` columns.

    Two references that have columns in common can't be drawn each for itself:
    the pair need not exist. Here a child row takes in turn a value of the shared
    columns that both parents have, and within it the pairs of parent rows in
    turn (an odometer), so each child row's references both hold. ``keys`` are
    the parents' own key columns. Parent rows with a null in a shared column are
    not drawn; without a common value all references of the child are null. Joins
    are equi-joins on value and number, which Spark can split.
    """
    (a, a_sizes), (b, b_sizes) = within(first, shared, keys[0]), within(second, shared, keys[1])
    common = cut(numbered(a_sizes.withColumnRenamed("_rows", "_a").join(b_sizes.withColumnRenamed("_rows", "_b"), shared), shared, "_group"))
    groups = common.count()
    if not groups:
        empty = [F.lit(None).cast(df.schema[c].dataType).alias(c) for df, cs in ((first, [*shared, *keys[0]]), (second, keys[1])) for c in cs]
        return child.select("*", *empty)
    turn = F.floor(F.col(row) / groups).cast("long")
    taken = child.withColumn("_group", F.pmod(F.col(row), F.lit(groups))).join(common, "_group")
    taken = taken.withColumn("_first", F.pmod(turn, F.col("_a"))).withColumn("_second", F.pmod(F.floor(turn / F.col("_a")).cast("long"), F.col("_b")))
    taken = taken.join(a.select(*shared, F.col("_local").alias("_first"), *keys[0]), [*shared, "_first"])
    taken = taken.join(b.select(*shared, F.col("_local").alias("_second"), *keys[1]), [*shared, "_second"])
    return taken.select(*child.columns, *shared, *keys[0], *keys[1])


def least_two(df: DataFrame, key: str) -> DataFrame:
    """One row: the least and the second least key (null where there is none), of the two that each task finds."""
    return df.select(F.col(key).alias("_k")).where("_k is not null").distinct().orderBy("_k").limit(2).agg(F.min("_k").alias("_least"), F.when(F.count("_k") > 1, F.max("_k")).alias("_next"))


def repaired(child: DataFrame, own: str, reference: str, parent: DataFrame, key: str) -> DataFrame:
    """A reference inside a cycle: every row but the one with the least own key refers to the least parent key other than its own.

    So no chain closes: the row without a reference is its end. A row whose own
    key is the only key of the parent has none either.
    """
    ends = child.agg(F.min(own).alias("_root")).crossJoin(least_two(parent, key))  # one row
    other = F.when(F.col("_least") != F.col(own), F.col("_least")).otherwise(F.col("_next"))
    return child.drop(reference).crossJoin(F.broadcast(ends)).withColumn(reference, F.when(F.col(own) != F.col("_root"), other)).drop("_root", "_least", "_next")
