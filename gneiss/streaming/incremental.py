"""Generation and validation on streams.

Cell values depend on the row's number alone, so a stream of numbers becomes a
stream of rows by a map without state; checks on a stream are a filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import failed
from ..plans.synthesis import Plan


def rows(spark: SparkSession, plan: Plan, per_second: int = 1_000) -> DataFrame:
    """An endless stream of a table's rows, numbered by Spark's rate source."""
    numbers = spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("value").alias("id"))
    return numbers.select(*[make(F.col("id")).alias(name) for name, make in plan.columns.items()])


def broken(stream: DataFrame, checks: dict[str, str]) -> DataFrame:
    """The rows of a stream that break a check, with the names of the checks."""
    names = F.filter(F.array(*[F.when(failed(p), F.lit(n)) for n, p in checks.items()]), lambda x: x.isNotNull())
    return stream.withColumn("broken", names).where(F.size("broken") > 0)


def counted(stream: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows in each window of event time and group; late rows are waited for as long as told."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", window).alias("span"), by).agg(F.count(F.lit(1)).alias("rows")).select(F.col("span.start").alias("start"), by, "rows")
