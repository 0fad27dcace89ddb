"""Connected components of a table of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import cut


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id that occurs in links (a, b): the least id it can reach.

    Each round takes the least label among the neighbours and then the label of
    that label, so the rounds grow with the logarithm of the longest path.
    Labels are combined before each shuffle and an id with very many links is a
    skewed join side that Spark can split. Null ends are no links.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("was"), F.least("component", "m").alias("now"))
        jump = step.alias("s").join(labels.alias("l"), F.col("s.now") == F.col("l.id"), "left")
        new = cut(jump.select(F.col("s.id").alias("id"), "was", F.least("now", F.coalesce("component", "now")).alias("component")))
        if new.where("component < was").limit(1).count() == 0:
            return new.select("id", "component")
        labels = new.select("id", "component")
