"""The graph of references between tables: order, closures, cycles.

All functions take DataFrames: ``tables`` (table_name) and ``edges`` (child,
parent, optional, deferrable), and run as joins, so that the catalogs of many
schemas can be ordered at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shapes import glob
from ..sources.shared import cut


def edges(references: DataFrame, tables: DataFrame) -> DataFrame:
    """Edges between different tables of the catalog; several references are one edge, optional if all are."""
    e = references.select(F.col("table_name").alias("child"), "parent", "optional", "deferrable").where("child <> parent")
    e = e.join(tables.select(F.col("table_name").alias("parent")), "parent", "left_semi")
    return e.groupBy("child", "parent").agg(F.min("optional").alias("optional"), F.min("deferrable").alias("deferrable"))


def closure(edges: DataFrame) -> DataFrame:
    """(child, ancestor) for all ways along the edges; paths double each round, cycles are no trouble."""
    pairs = cut(edges.select("child", F.col("parent").alias("ancestor")).distinct())
    size = pairs.count()
    while True:
        longer = pairs.alias("x").join(pairs.alias("y"), F.col("x.ancestor") == F.col("y.child")).select(F.col("x.child").alias("child"), F.col("y.ancestor").alias("ancestor"))
        pairs = cut(pairs.union(longer).distinct())
        now = pairs.count()
        if now == size:
            return pairs
        size = now


def levels(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """table_name, level: the longest way to a table without parents; null for tables in or above a cycle."""
    known = cut(tables.select("table_name", F.lit(None).cast("int").alias("level")))
    left = known.count()
    level = 0
    while left:
        open_ = known.where("level is null").select("table_name")
        waiting = edges.join(open_.select(F.col("table_name").alias("parent")), "parent", "left_semi").select(F.col("child").alias("table_name")).distinct()
        ready = open_.join(waiting, "table_name", "left_anti").withColumn("now", F.lit(level))
        known = cut(known.join(ready, "table_name", "left").select("table_name", F.coalesce("level", "now").alias("level")))
        still = known.where("level is null").count()
        if still == left:
            break
        left, level = still, level + 1
    return known


def cycles(edges: DataFrame) -> DataFrame:
    """cycle (its least table), table_name, strategy of each table that reaches itself.

    ``null_then_update``: leaving out optional edges breaks the cycle;
    ``deferred``: what is left can be checked at the end; else ``impossible``.
    """
    ways = closure(edges)
    back = ways.select(F.col("ancestor").alias("child"), F.col("child").alias("ancestor"))
    mutual = cut(ways.join(back, ["child", "ancestor"]))
    member = mutual.groupBy(F.col("child").alias("table_name")).agg(F.min("ancestor").alias("cycle"))
    inside = edges.join(member.select(F.col("table_name").alias("child"), "cycle"), "child").join(member.select(F.col("table_name").alias("parent"), F.col("cycle").alias("other")), "parent").where("cycle = other")
    required = cut(inside.where("not optional"))
    stuck = closure(required).where("child = ancestor").select("child")
    kept = required.join(stuck, "child", "left_semi").groupBy("cycle").agg(F.min("deferrable").alias("can_wait"))
    strategy = F.when(F.col("can_wait").isNull(), "null_then_update").when(F.col("can_wait"), "deferred").otherwise("impossible")
    return member.join(kept, "cycle", "left").select("cycle", "table_name", strategy.alias("strategy"))


def contagion(tables: DataFrame, references: DataFrame, refused: DataFrame) -> DataFrame:
    """table_name, verdict, reason of each table.

    ``refused`` has table_name and reason. A required reference to a refused
    table refuses its table (``depends_on_refused``); one to a table that is not
    in the catalog as well (``depends_on_unread``). Optional references do not.
    """
    required = references.where("not optional and table_name <> parent").select("table_name", "parent").distinct()
    unread = required.join(tables.select(F.col("table_name").alias("parent")), "parent", "left_anti").select("table_name", F.lit("depends_on_unread").alias("reason"))
    bad = cut(refused.select("table_name", "reason").union(unread).groupBy("table_name").agg(F.max("reason").alias("reason")))
    while True:
        new = required.join(bad.select(F.col("table_name").alias("parent")), "parent", "left_semi").select("table_name").distinct().join(bad, "table_name", "left_anti")
        new = cut(new.select("table_name", F.lit("depends_on_refused").alias("reason")))
        if new.isEmpty():
            break
        bad = cut(bad.union(new))
    return tables.select("table_name").join(bad, "table_name", "left").select("table_name", F.when(F.col("reason").isNull(), "filled").otherwise("refused").alias("verdict"), F.coalesce("reason", F.lit("")).alias("reason"))


def selection(tables: DataFrame, edges: DataFrame, include: DataFrame, exclude: DataFrame) -> DataFrame:
    """table_name, how: ``asked`` for by a pattern, or ``needed`` above one that is.

    ``include`` and ``exclude`` have a column pattern. No pattern at all asks for
    every table; an excluded table is never taken, needed or not.
    """
    t = cut(tables.select("table_name"))

    def matching(patterns: DataFrame) -> DataFrame:
        return t.join(patterns, F.rlike(F.col("table_name"), glob(F.col("pattern"))), "left_semi")

    hit, out = (t if include.isEmpty() else matching(include)), matching(exclude)
    asked = cut(hit.join(out, "table_name", "left_anti").distinct())
    above = closure(edges).join(asked.select(F.col("table_name").alias("child")), "child", "left_semi").select(F.col("ancestor").alias("table_name")).distinct()
    needed = above.join(asked, "table_name", "left_anti").join(out, "table_name", "left_anti")
    return asked.withColumn("how", F.lit("asked")).unionByName(needed.withColumn("how", F.lit("needed")))
