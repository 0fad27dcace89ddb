"""Small Spark helpers used by every operator of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A piece of a batch that is worked on at once has at most this many characters (or one text).
PIECE_CHARS = 400_000
PIECE_ROWS = 2_000
#: Rows that go to a Python worker at once, where the session has Spark's default of ten thousand. Texts are long.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 500
#: Rows of one or two numbers up to which a table may be broadcast after it has been counted (70 MB as a hash table).
BROADCAST_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder of the cluster.

    The folder is ``spark.checkpoint.dir``; only where that is unset (tests,
    notebooks in local mode) a temporary folder is taken.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, the session's own checkpoint folder; a session in local
    mode without one gets a temporary folder, on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gneiss-"))
    return root or spark.sparkContext.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder; smaller than a checkpoint where rows are many.

    Tables stay there like checkpoint files of a session that ended; whoever
    owns the folder empties it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a narrow table that has been counted and is small; else as it is.

    The hint only picks the way a join is carried out: above the limit the same
    join shuffles. ``df`` should be cheap to count (a checkpoint).
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``_file`` and ``_row``: rows stand in the order of their file's name, shorter ones first, and of their number in it.

    That is the order in which a sorted table was written. Rows that are not
    read from Parquet files stand in the order of the frame's partitions.
    """
    try:
        return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return df.select("*", F.spark_partition_id().cast("string").alias("_file"), F.monotonically_increasing_id().alias("_row"))


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:  # noqa: ANN001
    """``mapInArrow`` with batches that stay small for texts; a batch size that the session has set is kept."""
    conf = df.sparkSession.conf
    if conf.get(BATCH, "10000") == "10000":
        conf.set(BATCH, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], ddl: str, chars: int = PIECE_CHARS) -> DataFrame:
    """``work`` over pieces of the rows: dict of columns in, dict of columns out.

    The first string column decides how large a piece is, so that memory stays
    the same for many short and few very long texts.
    """
    schema = arrow_schema(ddl)
    weigh = next((f.name for f in df.schema.fields if f.dataType.typeName() == "string"), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, weigh, chars):
            out = work(piece)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in schema], schema=schema)

    return map_batches(df, run, ddl)


def slices(batches: Iterator[pa.RecordBatch], weigh: str | None, chars: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of at most so many bytes in the column (or one row), and of few rows."""
    import pyarrow.compute as pc

    for whole in batches:
        sizes = pc.fill_null(pc.binary_length(whole.column(weigh)), 0).to_numpy(zero_copy_only=False) if weigh else None
        at, n = 0, whole.num_rows
        while at < n:
            end, total = at, 0
            while end < n and end - at < PIECE_ROWS and (end == at or sizes is None or total + sizes[end] <= chars):
                total += int(sizes[end]) if sizes is not None else 0
                end += 1
            yield whole.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()


def pieces(batches: Iterator[pa.RecordBatch], weigh: str | None, chars: int = PIECE_CHARS) -> Iterator[dict[str, list]]:
    """The same as dicts of columns."""
    for part in slices(batches, weigh, chars):
        yield part.to_pydict()
