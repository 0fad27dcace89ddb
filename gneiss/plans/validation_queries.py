"""Queries over the constraints of the test data, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validate
from ..sources.catalog import TESTDATA
from ..sources.shared import read


def constraint_report(spark: SparkSession, d: str) -> DataFrame:
    """Every declared constraint and how many violations the tables hold."""
    return validate.report(TESTDATA, lambda name: read(spark, d, name))


def notnull_report(spark: SparkSession, d: str) -> DataFrame:
    parts = [validate.scanned(read(spark, d, t.name), t).where("kind = 'notnull'") for t in TESTDATA.values()]
    return reduce(DataFrame.unionByName, parts).select("table_name", F.split("constraint_name", ":")[1].alias("column_name"), F.col("violations").alias("nulls"))


def check_report(spark: SparkSession, d: str) -> DataFrame:
    parts = [validate.scanned(read(spark, d, t.name), t).where("kind = 'check'") for t in TESTDATA.values() if t.checks]
    return reduce(DataFrame.unionByName, parts).select("table_name", F.split("constraint_name", ":")[1].alias("check_name"), "violations")


def unique_report(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for t in TESTDATA.values():
        for key in t.keys:
            dup = validate.duplicates(read(spark, d, t.name), key)
            parts.append(dup.agg(F.count(F.lit(1)).alias("dup_groups"), F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("dup_rows")).select(F.lit(t.name).alias("table_name"), F.lit(",".join(key)).alias("key_columns"), "dup_groups", "dup_rows"))
    return reduce(DataFrame.unionByName, parts)


def unique_lower_report(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for table, column in (("part", "p_name"), ("nation", "n_name"), ("customer", "c_name")):
        dup = validate.duplicates(read(spark, d, table), (column,), fold=True)
        parts.append(dup.agg(F.count(F.lit(1)).alias("dup_groups")).select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "dup_groups"))
    return reduce(DataFrame.unionByName, parts)


def fk_orphans(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for t in TESTDATA.values():
        for r in t.references:
            child = read(spark, d, t.name).select(*r.columns)
            rows = child.agg(F.count(F.lit(1)).alias("child_rows"))
            lost = validate.orphans(child, r, read(spark, d, r.table)).agg(F.count(F.lit(1)).alias("orphans"))
            parts.append(rows.crossJoin(lost).select(F.lit(f"{t.name}.{','.join(r.columns)} -> {r.table}").alias("reference"), "child_rows", "orphans"))  # one row each
    return reduce(DataFrame.unionByName, parts)


def fk_fanout(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for t in TESTDATA.values():
        for r in t.references:
            parts.append(validate.fanout(read(spark, d, t.name), r, read(spark, d, r.table)).select(F.lit(f"{t.name}.{','.join(r.columns)} -> {r.table}").alias("reference"), "childless", "single", "many"))
    return reduce(DataFrame.unionByName, parts)


def length_fit(spark: SparkSession, d: str) -> DataFrame:
    parts = [validate.text_extents(read(spark, d, t.name), t) for t in TESTDATA.values() if any(f.type == "string" for f in t.fields)]
    return reduce(DataFrame.unionByName, parts)


def lifecycle_order(spark: SparkSession, d: str) -> DataFrame:
    """Lines shipped before they were ordered, by the year of the order."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderdate")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("lines"), F.sum((F.col("l_shipdate") < F.col("o_orderdate")).cast("int")).cast("long").alias("violations"))


def violation_summary(spark: SparkSession, d: str) -> DataFrame:
    r = constraint_report(spark, d).rollup("kind", "table_name").agg(F.sum("violations").cast("long").alias("violations"), F.count(F.lit(1)).alias("constraints"))
    return r.select(F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce("table_name", F.lit("all")).alias("table_name"), "violations", "constraints")


QUERIES = {
    "v_constraint_report": constraint_report, "v_notnull_report": notnull_report, "v_check_report": check_report, "v_unique_report": unique_report, "v_unique_lower_report": unique_lower_report,
    "v_fk_orphans": fk_orphans, "v_fk_fanout": fk_fanout, "v_length_fit": length_fit, "v_lifecycle_order": lifecycle_order, "v_violation_summary": violation_summary,
}


def _sql() -> dict[str, str]:
    rows: dict[str, list[str]] = {k: [] for k in ("null", "check", "unique", "orphans", "fanout", "extent", "all")}
    for t in TESTDATA.values():
        n = t.name
        for f in t.fields:
            rows["null"].append(f"select '{n}' as table_name, '{f.name}' as column_name, count(*) filter ({f.name} is null)::BIGINT as nulls from {n}")
            rows["all"].append(f"select '{n}' as table_name, 'notnull:{f.name}' as constraint_name, 'notnull' as kind, count(*) filter ({f.name} is null)::BIGINT as violations from {n}")
            if f.type == "string":
                rows["extent"].append(f"select '{n}' as table_name, '{f.name}' as column_name, max(length({f.name}))::BIGINT as max_chars, max(strlen({f.name}))::BIGINT as max_bytes from {n}")
        for name, text in t.checks:
            text = text.replace("char_length", "length")
            rows["check"].append(f"select '{n}' as table_name, '{name}' as check_name, count(*) filter (({text}) is false)::BIGINT as violations from {n}")
            rows["all"].append(f"select '{n}', 'check:{name}', 'check', count(*) filter (({text}) is false)::BIGINT from {n}")
        for i, key in enumerate(t.keys):
            cols, kind = ", ".join(key), "primary" if t.primary and i == 0 else "unique"
            whole = " and ".join(f"{c} is not null" for c in key)
            inner = f"select count(*) as c from {n} where {whole} group by {cols} having count(*) > 1"
            rows["unique"].append(f"select '{n}' as table_name, '{','.join(key)}' as key_columns, count(*)::BIGINT as dup_groups, coalesce(sum(c), 0)::BIGINT as dup_rows from ({inner})")
            rows["all"].append(f"select '{n}', '{kind}:{','.join(key)}', '{kind}', count(*)::BIGINT from ({inner})")
        for r in t.references:
            (c,), (k,) = r.columns, r.keys
            label = f"{n}.{c} -> {r.table}"
            lost = f"(select count(*) from {n} x where x.{c} is not null and not exists (select 1 from {r.table} y where y.{k} = x.{c}))"
            rows["orphans"].append(f"select '{label}' as reference, (select count(*) from {n})::BIGINT as child_rows, {lost}::BIGINT as orphans")
            rows["all"].append(f"select '{n}', 'reference:{c}', 'reference', {lost}::BIGINT")
            per = f"select p.{k}, count(c.{c}) as m from {r.table} p left join {n} c on c.{c} = p.{k} group by p.{k}"
            rows["fanout"].append(f"select '{label}' as reference, count(*) filter (m = 0)::BIGINT as childless, count(*) filter (m = 1)::BIGINT as single, count(*) filter (m > 1)::BIGINT as many from ({per})")
    u = {k: "\nunion all ".join(v) for k, v in rows.items()}
    lower = "\nunion all ".join(f"select '{t}' as table_name, '{c}' as column_name, count(*)::BIGINT as dup_groups from (select lower({c}) from {t} group by 1 having count(*) > 1)" for t, c in (("part", "p_name"), ("nation", "n_name"), ("customer", "c_name")))
    return {
        "v_constraint_report": u["all"], "v_notnull_report": u["null"], "v_check_report": u["check"], "v_unique_report": u["unique"], "v_unique_lower_report": lower, "v_fk_orphans": u["orphans"], "v_fk_fanout": u["fanout"], "v_length_fit": u["extent"],
        "v_lifecycle_order": "select year(o_orderdate)::BIGINT as year, count(*)::BIGINT as lines, count(*) filter (l_shipdate < o_orderdate)::BIGINT as violations from lineitem join orders on l_orderkey = o_orderkey group by 1",
        "v_violation_summary": f"select coalesce(kind, 'all') as kind, coalesce(table_name, 'all') as table_name, sum(violations)::BIGINT as violations, count(*)::BIGINT as constraints from ({u['all']}) group by rollup(kind, table_name)",
    }


SQL = _sql()
