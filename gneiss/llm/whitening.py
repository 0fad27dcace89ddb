"""Embedding whitening: principal components of unit variance from a two-pass covariance.

The first pass adds up whole numbers, so that the mean is exact whatever the
order of tasks; the second one centres every vector before it is multiplied and
sums outer products as one matrix product a batch. Each task gives one row a
pass, which ``treeAggregate`` merges in tasks before anything reaches the
driver. The symmetric covariance, as large as a vector is long squared, goes
through LAPACK there, and the projection is broadcast to all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import arrow_schema, cut, map_batches, table, written

SCALE, SHIFT = 64.0, 1_000_000
#: Entries beyond this have no place in a long once scaled and shifted; they count as not finite.
LARGEST = 2.0**62 / SCALE
COMPONENTS = 16
#: Rows whose vectors are multiplied at once.
ROWS = 4_096
#: Levels of tasks in which partial sums are merged.
DEPTH = 2


@dataclass(frozen=True)
class Fit:
    """Mean as ``quotient + remainder / n`` (whole numbers), eigenvalues by falling size, unit eigenvectors as columns."""

    n: int
    quotient: np.ndarray
    remainder: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def sums(self) -> list[int]:
        return [self.n * int(q) + int(r) for q, r in zip(self.quotient, self.remainder, strict=True)]

    def projection(self, components: int) -> np.ndarray:
        """Columns that take a centred vector to its whitened entries; none where a variance is zero to rounding."""
        e = self.values[:components]
        return np.where(e > self.values[:1] * len(self.values) * np.finfo(float).eps, self.vectors[:, :components] / np.sqrt(np.maximum(e, np.finfo(float).tiny)), np.nan)


def whole(vector: Column) -> Column:
    """Entries as whole numbers; null where the vector is null or has an entry that is null or not finite."""
    c = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    return F.when(vector.isNotNull() & sound, F.transform(c, lambda x: F.floor(x * SCALE).cast("long") + F.lit(SHIFT)))


def vectors(df: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, x: the rows with a sound vector of the usual length."""
    rows = df.select(F.col(key).alias("vec_id"), whole(F.col(column)).alias("x")).where("x is not null and size(x) > 0")
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == usual[0]["d"]) if usual else rows


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return pc.list_flatten(batch.column("x")).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def merged(df: DataFrame, work, kind: str = "<f8"):  # noqa: ANN001, ANN201
    """Partial results of the partitions, merged in a tree of tasks; None if there is none.

    ``work`` gives one matrix of ``kind`` from an iterator of matrices, or None without rows. Whole numbers are merged without bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = work(m for b in batches if b.num_rows for m in np.array_split(matrix(b), -(-b.num_rows // ROWS)))
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array([got.tobytes()], pa.binary()), pa.array([got.shape[0]], pa.int32())], ["sums", "rows"])

    def both(a, b):  # noqa: ANN001, ANN202
        return b if a is None else a if b is None else a + b

    def read(row) -> np.ndarray:  # noqa: ANN001
        m = np.frombuffer(row["sums"], kind).reshape(row["rows"], -1)
        return m.astype(object) if kind == "<i8" else m

    parts = map_batches(df.select("x"), run, "sums binary, rows int").rdd
    return parts.treeAggregate(None, lambda a, row: both(a, read(row)), both, DEPTH)


def _whole_sums(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
    """Count, and sums of the upper and the lower 32 bits of entries: exact for 2**31 rows a task."""
    out = None
    for m in blocks:
        part = np.stack([np.full(m.shape[1], len(m)), (m >> 32).sum(0), (m & 0xFFFFFFFF).sum(0)])
        out = part if out is None else out + part
    return out


def centred(m: np.ndarray, quotient: np.ndarray, remainder: np.ndarray, n: int) -> np.ndarray:
    """Vectors less the mean: whole numbers are subtracted as such, then the fraction."""
    return (m - quotient) - remainder / n


def products(df: DataFrame, centre) -> np.ndarray | None:  # noqa: ANN001
    """Sum of outer products of ``centre`` of the vectors."""

    def work(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        out = None
        for m in blocks:
            c = centre(m)
            out = c.T @ c if out is None else out + c.T @ c
        return out

    return merged(df, work)


def totals(df: DataFrame, centre) -> np.ndarray | None:  # noqa: ANN001
    def work(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        out = None
        for m in blocks:
            part = centre(m).sum(0, keepdims=True)
            out = part if out is None else out + part
        return out

    return merged(df, work)


def fit(distinct: DataFrame) -> Fit | None:
    """The components of a table of vectors ``x``, each of which counts once; None without a row."""
    got = merged(distinct, _whole_sums, "<i8")
    if got is None:
        return None
    n = int(got[0, 0])
    sums = [int(hi) * (1 << 32) + int(lo) for hi, lo in zip(got[1], got[2], strict=True)]
    quotient, remainder = (np.array(v, np.int64) for v in zip(*(divmod(s, n) for s in sums), strict=True))
    covariance = products(distinct, lambda m: centred(m, quotient, remainder, n)) / n
    values, vectors_ = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors_ = np.maximum(values[::-1], 0.0), vectors_[:, ::-1]
    largest = np.abs(vectors_).argmax(0)
    vectors_ = vectors_ * np.where(vectors_[largest, np.arange(len(values))] < 0, -1.0, 1.0)
    return Fit(n, quotient, remainder, values, vectors_, float(np.trace(covariance)))


def identity_error(distinct: DataFrame, found: Fit, components: int = COMPONENTS) -> float | None:
    """How far the covariance of the whitened vectors is from the identity, at its worst entry."""
    projection = found.projection(components)
    kept = projection[:, ~np.isnan(projection[0])]
    if not kept.shape[1]:
        return None

    def whitened(m: np.ndarray) -> np.ndarray:
        return centred(m, found.quotient, found.remainder, found.n) @ kept

    mean = totals(distinct, whitened) / found.n
    return float(np.abs(products(distinct, lambda m: whitened(m) - mean) / found.n - np.eye(kept.shape[1])).max())


def deviations(m: np.ndarray, found: Fit) -> list[int | None]:
    """Sum over dimensions of (n * x - S)**2, exact; None where it has no place in a long."""
    off = m - found.quotient
    most = found.n * (int(np.abs(off).max(initial=0)) + 1)
    if most * most * m.shape[1] < 1 << 63:
        d = off * found.n - found.remainder
        return (d * d).sum(1).tolist()
    d = off.astype(object) * found.n - found.remainder.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (d * d).sum(1)]


DDL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row for each sound vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds an entry that is null, not finite
    or too large for a long are left out; so are vectors of another length than
    most have (on a tie the longer length stays). Repeated rows give repeated
    results, but equal vectors count once in the fit. Components are numbered by
    falling variance; of equal ones any comes first. A component without
    variance (fewer distinct vectors than dimensions) has a null ``whitened``,
    a null ``explained`` if there is no variance at all, and is not in
    ``identity_error``. A null key is kept. Without vectors the result is empty.
    Other columns are not looked at. The driver holds matrices of a vector's
    length squared, nothing that grows with the rows.
    """
    rows = vectors(df, column, key)
    distinct = written(rows.select("x").distinct())
    found = fit(distinct)
    if found is None:
        return cut(df.sparkSession.createDataFrame([], DDL))
    error = identity_error(distinct, found, components)
    d = min(components, len(found.values))
    explained = found.values[:d] / found.trace if found.trace > 0 else np.full(d, np.nan)
    held = df.sparkSession.sparkContext.broadcast((found, found.projection(d)))
    schema = arrow_schema(DDL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, projection = held.value
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                m = matrix(part)
                w = centred(m, fitted.quotient, fitted.remainder, fitted.n) @ projection
                k = len(m) * d
                columns = [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(len(m)), d))).cast(pa.int64()),
                    pa.array(np.tile(np.arange(1, d + 1, dtype=np.int32), len(m))),
                    pa.array(np.full(k, fitted.n)),
                    pa.array([v for v in deviations(m, fitted) for _ in range(d)], pa.int64()),
                    pa.array(w.reshape(-1), from_pandas=True),
                    pa.array(np.tile(explained, len(m)), from_pandas=True),
                    pa.array([error] * k, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return map_batches(rows, run, DDL)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened on their first 16 components."""
    return whiten(table(spark, sf_dir, "embeddings"))
