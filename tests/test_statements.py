"""SQL text: a transaction that a database runs gives the tables back."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from gneiss.plans import synthesis
from gneiss.sources import statements
from gneiss.sources.catalog import table


def script(path, folders):
    """The text of all files in the order of folders."""
    return "\n".join(f.read_text() for folder in folders for f in sorted((path / folder).glob("part-*")))


def test_a_transaction_gives_the_rows_back(spark, tmp_path):
    rows = [(1, "it's; -- \n\\x", True, Decimal("1.50"), 1.25, dt.date(2024, 2, 29), dt.datetime(2024, 1, 1, 2, 3, 4), [[1, 2], [3]], ["a'b", None]), (2, None, None, None, None, None, None, None, []), (3, "", False, Decimal("-0.01"), float("inf"), None, None, [[]], ["", "NULL"])]
    ddl = "id int, t string, b boolean, d decimal(6,2), f double, day date, at timestamp_ntz, grid array<array<int>>, words array<string>"
    df = spark.createDataFrame(rows, ddl).select("id", "t", "b", "d", "f", "day", "at")
    folders = statements.write_sql(spark, {"odd \"name": df, "empty": df.where("false")}, str(tmp_path), rows=2)
    assert folders == ["00000-begin.sql", '00001-odd "name.sql', "00002-empty.sql", "00003-commit.sql"]
    c = duckdb.connect()
    for n in ('"odd ""name"', "empty"):
        c.sql(f"create table {n} (id int, t varchar, b boolean, d decimal(6,2), f double, day date, \"at\" timestamp)")
    text = script(tmp_path, folders)
    assert text.lstrip().startswith("BEGIN;") and text.rstrip().endswith("COMMIT;")
    c.execute(text)
    assert sorted(c.sql('select * from "odd ""name"').fetchall()) == sorted(tuple(r)[:7] for r in rows) and not c.sql("select * from empty").fetchall()
    nested = spark.createDataFrame(rows, ddl)
    arrays = nested.select("id", statements.literal(F.col("grid"), nested.schema["grid"].dataType).alias("g")).collect()
    assert {r.id: r.g for r in arrays} == {1: "ARRAY[ARRAY[1, 2], ARRAY[3]]", 2: "NULL", 3: "ARRAY['{}']"}


def test_generated_tables_run_as_a_script_with_their_constraints(spark, tmp_path):
    cat = {t.name: t for t in (table("makers", "id int, name varchar(40)", "id", ("name",)), table("parts", "id int, maker_id int, price numeric(6,2), made date null", "id", (), (("maker_id", "makers", "id"),), (("price", "price >= 5 AND price <= 9"),)))}
    made = synthesis.generate(spark, cat, {"makers": 20, "parts": 130})
    folders = statements.write_sql(spark, made, str(tmp_path), cat, rows=30)
    c = duckdb.connect()
    c.sql("create table makers (id int primary key, name varchar unique not null)")
    c.sql("create table parts (id int primary key, maker_id int not null references makers (id), price decimal(6,2) not null check (price between 5 and 9), made date)")
    c.execute(script(tmp_path, folders))
    assert c.sql("select (select count(*) from makers), (select count(*) from parts)").fetchall() == [(20, 130)]


def test_what_the_store_assigns_is_left_out(spark):
    t = table("logs", "id bigint sequence, at timestamp default now(), note text null", "id")
    assert statements.written(spark.createDataFrame([(1, None, "x")], "id long, at timestamp, note string"), t) == ["note"]
    only = table("ticks", "id bigint sequence, at timestamp default now()")
    got = [r.statement for r in statements.inserts(spark.range(3).selectExpr("id", "current_timestamp() as at"), "ticks", only).collect()]
    assert got == ['INSERT INTO "ticks" DEFAULT VALUES;'] * 3


def test_row_counts_are_read_or_named():
    assert statements.row_counts(["100", "log_*=5", "a=b=7"]) == (100, [("log_*", 5), ("a=b", 7)]) and statements.row_counts([]) == (50, [])
    for bad in ("x", "a=", "=5", "a=-1", "-3"):
        with pytest.raises(ValueError, match="neither"):
            statements.row_counts([bad])
