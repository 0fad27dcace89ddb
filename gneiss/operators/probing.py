"""Offering tables to the validator: each is written once, and kept only if it breaks no rule.

The not-null rules and checks of a table are counted by an ``Observation`` while
Spark writes it to the staging folder, so judging them reads nothing again. Keys
and references are counted on what was written. Children are held against the
parents that were kept. A table whose rows were proved to satisfy every rule and
break one stops the run: then the proof is wrong, and so may others be.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.catalog import Catalog, Table
from ..sources.shared import files, shared_folder
from .validate import duplicates, failed, orphans


class BrokenPromise(RuntimeError):
    """A table that was proved to satisfy its rules breaks some."""


@dataclass(frozen=True)
class Verdict:
    """What became of a table: its rows, violations by rule, and the staged rows if it was kept."""

    table: str
    rows: int
    broken: Mapping[str, int] = field(default_factory=dict)
    kept: DataFrame | None = None


def rules(df: DataFrame, table: Table) -> dict[str, Column]:
    """Counts of broken not-null rules and checks; rules on columns that the frame does not have are left out."""
    have = set(df.columns)
    counts = {f"notnull:{f.name}": F.sum(F.col(f.name).isNull().cast("long")) for f in table.fields if not f.nullable and f.name in have}
    return counts | {f"check:{name}": F.sum(failed(text).cast("long")) for name, text in table.checks}


def staged(df: DataFrame, table: Table, path: str) -> tuple[DataFrame, int, dict[str, int]]:
    """The rows as written to ``path``, how many they are, and which not-null rules and checks they break."""
    seen = Observation(f"{table.name}-{uuid.uuid4().hex}")
    counts = rules(df, table)
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counts.items()]).write.parquet(path)
    got = seen.get
    return df.sparkSession.read.schema(df.schema).parquet(path), got["rows"], {k: got[k] for k in counts if got[k]}


def related(df: DataFrame, table: Table, kept: Mapping[str, DataFrame]) -> dict[str, int]:
    """Groups of equal keys, and rows whose reference no kept parent has."""
    parts = [duplicates(df, key).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"unique:{','.join(key)}").alias("rule"), "n") for key in table.keys]
    for r in table.references:
        parent = df if r.table == table.name else kept.get(r.table)
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in r.columns])
        lost = df.where(whole) if parent is None else orphans(df, r, parent)
        parts.append(lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"reference:{','.join(r.columns)}").alias("rule"), "n"))
    return {r["rule"]: r["n"] for r in reduce(DataFrame.unionByName, parts).where("n > 0").collect()} if parts else {}  # a row a rule


def offered(tables: Iterable[tuple[str, DataFrame]], catalog: Catalog, proved: Collection[str] = (), path: str | None = None) -> Iterator[Verdict]:
    """Offer tables in dependency order; yields the verdict on each as soon as it is known.

    Rows are staged below ``path`` (the shared folder of the cluster if none is
    given); what is refused is deleted there. A caller that stops iterating
    writes no further table. A table in ``proved`` that breaks a rule raises
    :class:`BrokenPromise` after its rows are deleted; so does one whose parent
    was not offered at all. An empty table breaks nothing.
    """
    kept: dict[str, DataFrame] = {}
    for name, df in tables:
        t = catalog[name]
        root = path or f"{shared_folder(df.sparkSession)}/probe-{uuid.uuid4().hex}"
        rows, n, broken = staged(df, t, f"{root}/{name}.parquet")
        broken = broken | related(rows, t, kept)
        if broken:
            fs, at = files(df.sparkSession, f"{root}/{name}.parquet")
            fs.delete(at, True)
            if name in proved:
                raise BrokenPromise(f"{name} was proved to satisfy its rules and breaks {', '.join(f'{k} ({v})' for k, v in sorted(broken.items()))}")
            yield Verdict(name, n, broken)
        else:
            kept[name] = rows
            yield Verdict(name, n, {}, rows)
