"""Reading tables, cutting lineage, and publishing results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Collection, Iterable, Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool
from urllib.parse import urlparse

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the session's checkpoint folder; only a session in local mode that has none takes a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gneiss-"))
    return root or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def is_local(path: str) -> bool:
    """Is this a path of this machine? Anything that is not sure is not."""
    url = urlparse(path)
    return url.scheme in ("", "file") and url.netloc in ("", "localhost")


def files(spark: SparkSession, path: str):  # noqa: ANN201
    """Hadoop's file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def is_filled(spark: SparkSession, path: str) -> bool:
    """Is there a table with a row? Reads one row at most."""
    fs, at = files(spark, path)
    return bool(fs.exists(at)) and not spark.read.parquet(path).isEmpty()


class Stopped(RuntimeError):
    """Writing was stopped by its caller."""


def in_order(tables: Mapping[str, DataFrame], path: str, *, tag: str | None = None) -> Iterator[tuple[str, int]]:
    """Write tables one after the other, each before the next is asked for; yields name and rows.

    Rows are counted while they are written. All jobs carry ``tag``, so that
    :func:`stop` with it, from any thread, cancels the one that runs: the
    iterator then raises :class:`Stopped` and what is half written is deleted. A
    caller that stops iterating writes nothing more; tables written stay.
    """
    tag = tag or f"write-{uuid.uuid4().hex}"
    for name, df in tables.items():
        spark, seen = df.sparkSession, Observation(f"{name}-{uuid.uuid4().hex}")
        spark.sparkContext.addJobTag(tag)
        try:
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/{name}.parquet")
        except BaseException as why:
            fs, at = files(spark, f"{path}/{name}.parquet")
            fs.delete(at, True)
            if "cancel" in str(why).lower():
                raise Stopped(f"{name} was being written") from why
            raise
        finally:
            spark.sparkContext.removeJobTag(tag)
        yield name, seen.get["rows"]


def at_once(tables: Mapping[str, DataFrame], write: Callable[[str, DataFrame], None], workers: int = 8) -> None:
    """Write tables that do not wait for each other, some at a time: small jobs share the cluster.

    The first failure is raised once the jobs that run have ended.
    """
    with ThreadPool(min(workers, max(1, len(tables)))) as pool:
        pool.starmap(inheritable_thread_target(write), tables.items(), 1)


def stop(spark: SparkSession, tag: str) -> None:
    """Cancel the jobs that carry the tag."""
    spark.sparkContext.cancelJobsWithTag(tag)


def emptied(spark: SparkSession, path: str, targets: Iterable[str], children: Mapping[str, Collection[str]], order: Sequence[str]) -> list[str]:
    """Delete the target tables and all that refer to them, children before parents; the names in that order.

    ``children`` names the tables that refer to each table, ``order`` has parents
    first. Tables that are not there are passed over; a table that refers to a
    target is deleted even if it is no target, as its references would be lost.
    """
    gone, front = set(targets), list(targets)
    while front:
        front = [c for p in front for c in children.get(p, ()) if c not in gone]
        gone |= set(front)
    out = []
    for name in reversed([n for n in order if n in gone]):
        fs, at = files(spark, f"{path}/{name}.parquet")
        if fs.exists(at):
            fs.delete(at, True)
            out.append(name)
    return out


def publish(tables: dict[str, DataFrame], path: str, *, overwrite: bool = False, remote: bool = False) -> dict[str, int]:
    """Write all tables beside the target, then move them there: all of them or none.

    Tables that are there already are moved aside first and come back if any
    move fails or the run is interrupted. Refuses targets on other machines
    unless ``remote``, and filled ones unless ``overwrite``. Returns the rows of
    each table. If even the way back fails, the staging folder stays, with the
    old tables in it, and the error names it.
    """
    spark = next(iter(tables.values())).sparkSession
    if not remote and not is_local(path):
        raise ValueError(f"{path} is not on this machine")
    if not overwrite and (filled := [n for n in tables if is_filled(spark, f"{path}/{n}.parquet")]):
        raise ValueError(f"these tables have rows: {', '.join(sorted(filled))}")
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    fs, at = files(spark, staging)
    done: list[tuple[str, str]] = []
    restored = True
    try:
        counts = dict(in_order(tables, staging))
        fs.mkdirs(files(spark, f"{staging}/_old")[1])
        try:
            for name in tables:
                target, old = f"{path}/{name}.parquet", f"{staging}/_old/{name}.parquet"
                if fs.exists(files(spark, target)[1]):
                    done.append((target, old))
                    moved(spark, target, old)
                done.append((f"{staging}/{name}.parquet", target))
                moved(spark, f"{staging}/{name}.parquet", target)
        except BaseException:
            restored = False
            for source, target in reversed(done):
                # The last move may have failed or been interrupted before it took place.
                if fs.exists(files(spark, target)[1]) and not fs.exists(files(spark, source)[1]):
                    moved(spark, target, source)
            restored = True
            raise
    except BaseException as why:
        if not restored:
            raise OSError(f"tables could not be moved back; the old ones are in {staging}/_old") from why
        raise
    finally:
        if restored:
            fs.delete(at, True)
    return counts


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; raises where the file system does not."""
    fs, at = files(spark, source)
    if not fs.rename(at, files(spark, target)[1]):
        raise OSError(f"could not move {source} to {target}")
