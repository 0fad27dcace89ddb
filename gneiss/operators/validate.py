"""Constraint validation: which rows of a table break which rule.

Nulls follow the usual rules of relational constraints: a check passes when it
is true or null, keys with a null in them are distinct, and a reference with a
null in it is not followed.

All not-null rules and checks of a table cost one scan without a shuffle. Keys
cost a grouped count that is combined before its shuffle; texts longer than a
key should be are grouped by digest. References are anti-joins against the
parent's keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spelling
from ..sources.catalog import Catalog, Reference, Table

REPORT = "table_name string, constraint_name string, kind string, violations long"


def _rows(df: DataFrame, table: str, kind: str, counts: dict[str, Column]) -> DataFrame:
    """One row a constraint from one aggregate over the table."""
    named = [F.coalesce(c, F.lit(0)).cast("long").alias(f"c{i}") for i, c in enumerate(counts.values())]
    row = F.array(*[F.struct(F.lit(name).alias("constraint_name"), F.lit(k).alias("kind"), F.col(f"c{i}").alias("violations")) for i, (name, k) in enumerate((n, kind if kind else n.partition(":")[0]) for n in counts)])
    return df.agg(*named).select(F.lit(table).alias("table_name"), F.explode(row).alias("r")).select("table_name", "r.constraint_name", "r.kind", "r.violations")


def failed(predicate: str | Column) -> Column:
    """True where a check is neither true nor null. Texts are in a catalog's spelling, or in Spark's where that is not known."""
    if isinstance(predicate, str):
        try:
            predicate = spelling.evaluated(predicate)
        except spelling.Unread:
            predicate = F.expr(predicate)
    return ~F.coalesce(predicate, F.lit(True))


def scanned(df: DataFrame, table: Table) -> DataFrame:
    """Nulls in not-null columns, and broken checks: one pass."""
    counts = {f"notnull:{f.name}": F.sum(F.col(f.name).isNull().cast("int")) for f in table.fields if not f.nullable}
    counts |= {f"check:{name}": F.sum(failed(text).cast("int")) for name, text in table.checks}
    return _rows(df, table.name, "", counts)


def _key(df: DataFrame, columns: tuple[str, ...], fold: bool = False) -> list[Column]:
    """Key columns, in lower case if folded; texts of more than 64 bytes stand as their digests."""
    kinds, out = dict(df.dtypes), []
    for c in columns:
        value = F.lower(F.col(c)) if fold else F.col(c)
        out.append((F.when(F.octet_length(value) > 64, F.sha2(value, 256)).otherwise(value) if kinds[c] == "string" else value).alias(c))
    return out


def duplicates(df: DataFrame, columns: tuple[str, ...], fold: bool = False) -> DataFrame:
    """Keys that occur more than once: the columns and ``copies``."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.where(whole).groupBy(*_key(df, columns, fold)).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def orphans(child: DataFrame, ref: Reference, parent: DataFrame) -> DataFrame:
    """Rows of the child whose reference no parent has."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ref.columns])
    keys = parent.select(*[F.col(k).alias(f"_{c}") for c, k in zip(ref.columns, ref.keys, strict=True)])
    return child.where(whole).join(keys, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in ref.columns]), "left_anti")


def report(catalog: Catalog, load: Callable[[str], DataFrame]) -> DataFrame:
    """Every declared constraint with its violations: rows, for keys groups of equal rows."""
    parts = []
    for t in catalog.values():
        df = load(t.name)
        parts.append(scanned(df, t))
        for i, key in enumerate(t.keys):
            kind = "primary" if t.primary and i == 0 else "unique"
            parts.append(_rows(duplicates(df, key), t.name, kind, {f"{kind}:{','.join(key)}": F.count(F.lit(1))}))
        for r in t.references:
            parts.append(_rows(orphans(df.select(*r.columns), r, load(r.table)), t.name, "reference", {f"reference:{','.join(r.columns)}": F.count(F.lit(1))}))
    return reduce(DataFrame.unionByName, parts)


def fanout(child: DataFrame, ref: Reference, parent: DataFrame) -> DataFrame:
    """How many parents have no, one, or many children."""
    (c,), (k,) = ref.columns, ref.keys
    counts = child.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    joined = parent.select(F.col(k).alias("_p")).join(counts, F.col("_p") == F.col("_k"), "left")
    return joined.agg(F.sum((n == 0).cast("int")).cast("long").alias("childless"), F.sum((n == 1).cast("int")).cast("long").alias("single"), F.sum((n > 1).cast("int")).cast("long").alias("many"))


def text_extents(df: DataFrame, table: Table) -> DataFrame:
    """The most characters and bytes in each text column."""
    texts = [f.name for f in table.fields if f.type == "string"]
    made = [x for i, c in enumerate(texts) for x in (F.max(F.char_length(c)).cast("long").alias(f"l{i}"), F.max(F.octet_length(c)).cast("long").alias(f"b{i}"))]
    row = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"l{i}").alias("max_chars"), F.col(f"b{i}").alias("max_bytes")) for i, c in enumerate(texts)])
    return df.agg(*made).select(F.lit(table.name).alias("table_name"), F.explode(row).alias("r")).select("table_name", "r.*")


def roots(df: DataFrame, parent_column: str) -> DataFrame:
    """How many rows of a hierarchy have no parent."""
    return df.agg(F.sum(F.col(parent_column).isNull().cast("int")).cast("long").alias("roots"))
