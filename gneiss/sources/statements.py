"""Tables as SQL text: literals, INSERT statements of several rows, and files that run as one transaction.

Statements are put together where the rows are; nothing is sorted or shuffled,
and no file is larger than its partition. What the store assigns itself is left
out, and a table of which it assigns everything is written as DEFAULT VALUES.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from ..functions.shapes import quoted
from .catalog import Catalog, Table

BARE = ("tinyint", "smallint", "int", "bigint", "decimal")


def name(text: str) -> str:
    """A name in quotes, quotes in it doubled."""
    return '"' + text.replace('"', '""') + '"'


def literal(value: Column, kind: DataType) -> Column:
    """A value as a literal of standard SQL; null as NULL.

    Numbers and truth values stand bare, fractions that are no finite number in
    quotes, bytes as hexadecimal text, arrays of any depth entry by entry.
    """
    if isinstance(kind, ArrayType):
        items = F.transform(value, lambda x: literal(x, kind.elementType))
        made = F.when(F.size(value) == 0, F.lit("'{}'")).otherwise(F.concat(F.lit("ARRAY["), F.array_join(items, ", "), F.lit("]")))
    elif kind.simpleString().startswith(BARE):
        made = value.cast("string")
    elif kind.typeName() == "boolean":
        made = F.upper(value.cast("string"))
    elif kind.typeName() in ("float", "double"):
        made = F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), quoted(value.cast("string"))).otherwise(value.cast("string"))
    elif kind.typeName() == "binary":
        made = quoted(F.concat(F.lit("\\x"), F.lower(F.hex(value))))
    elif kind.simpleString().startswith("interval"):
        made = value.cast("string")
    else:
        made = quoted(value.cast("string"))
    return F.when(value.isNull(), F.lit("NULL")).otherwise(made)


def written(df: DataFrame, table: Table | None) -> list[str]:
    """The columns that statements give: those that the frame has and rows of the table must give."""
    return df.columns if table is None else [f.name for f in table.written() if f.name in df.columns]


def inserts(df: DataFrame, target: str, table: Table | None = None, rows: int = 500) -> DataFrame:
    """``statement``: INSERT statements of up to so many rows each, one a line but for line ends in texts."""
    columns = written(df, table)
    if not columns:
        return df.select(F.lit(f"INSERT INTO {name(target)} DEFAULT VALUES;").alias("statement"))
    head = f"INSERT INTO {name(target)} ({', '.join(map(name, columns))}) VALUES\n"
    values = df.select(F.concat(F.lit("("), F.concat_ws(", ", *[literal(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns]), F.lit(")")).alias("v"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"statement": [head + ",\n".join(texts[i : i + rows]) + ";" for i in range(0, len(texts), rows)]})

    return values.mapInArrow(joined, "statement string")


def statements(tables: Mapping[str, DataFrame], catalog: Catalog | None = None, rows: int = 500) -> Iterator[tuple[str, DataFrame]]:
    """(table, its statements) in the order of ``tables``."""
    for n, df in tables.items():
        yield n, inserts(df, n, (catalog or {}).get(n), rows)


def write_sql(spark: SparkSession, tables: Mapping[str, DataFrame], path: str, catalog: Catalog | None = None, rows: int = 500) -> list[str]:
    """Write folders of SQL text below ``path`` which, run in the order of their names, are one transaction; those names.

    The first holds BEGIN, the last COMMIT, those between the rows of a table
    each, parents first if ``tables`` are. An empty table has a folder without
    statements.
    """
    done = []

    def put(label: str, df: DataFrame) -> None:
        df.write.text(f"{path}/{len(done):05d}-{label}.sql")
        done.append(f"{len(done):05d}-{label}.sql")

    put("begin", spark.range(0, 1, 1, 1).select(F.lit("BEGIN;").alias("statement")))
    for n, df in statements(tables, catalog, rows):
        put(n, df)
    put("commit", spark.range(0, 1, 1, 1).select(F.lit("COMMIT;").alias("statement")))
    return done


def row_counts(arguments: list[str], default: int = 50) -> tuple[int, list[tuple[str, int]]]:
    """(default, [(pattern, rows)]) from arguments such as ``100`` and ``log_*=5``; a later pattern that matches counts.

    Raises ValueError for what is no whole number of at least 0, and for a
    pattern without a name.
    """
    overrides = []
    for a in arguments:
        pattern, sign, count = a.rpartition("=")
        if not count.strip().isdigit() or (sign and not pattern.strip()):
            raise ValueError(f"{a!r} is neither a number of rows nor pattern=rows")
        if sign:
            overrides.append((pattern.strip(), int(count)))
        else:
            default = int(count)
    return default, overrides
