"""Queries over catalogs: facts, readings of constraint texts, order, refusals, sizes, selection, surveys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import nouns, shapes
from ..operators import graph, validate
from ..sources.catalog import SHOP, TESTDATA, Catalog, frames, table
from ..sources.shared import read
from . import synthesis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _values(rows: list[tuple], columns: str) -> str:
    """A SQL table of literal rows; ``columns`` with types."""
    names = [c.split()[0] for c in columns.split(", ")]
    one = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"{c.split()[0]}::{c.split()[1]} as {c.split()[0]}" for c in columns.split(", "))
    return f"select {casts} from (values {body}) t({', '.join(names)})"


# Catalog facts -------------------------------------------------------------
def cat_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the tables that are there, with the types of the catalog."""
    rows = [(t, i + 1, f.name, f.dataType.simpleString()) for t in sorted(TESTDATA) for i, f in enumerate(read(spark, d, t).schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position long, column_name string, type string")


def cat_key_columns(spark: SparkSession, d: str) -> DataFrame:
    """Key columns as ordered lists, put together again from one row a column."""
    keys = frames(spark, TESTDATA)["keys"].select("table_name", "ordinal", F.posexplode("columns").alias("at", "column_name"))
    return keys.groupBy("table_name", "ordinal").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "column_name"))), lambda x: x["column_name"]), ",").alias("columns")).select("table_name", F.col("ordinal").cast("long").alias("ordinal"), "columns")


def cat_fk_edges(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, TESTDATA)
    return graph.edges(f["references"], f["tables"]).select("child", "parent", "optional")


ENUMS = [("public", "mood", "sad", 1), ("public", "mood", "ok", 2), ("public", "mood", "happy", 3), ("app", "state", "open", 1), ("app", "state", "closed", 2), ("public", "state", "on", 1)]


def cat_enum_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels in their order; a name that several schemas have is ambiguous."""
    e = spark.createDataFrame(ENUMS, "schema string, name string, label string, ord int")
    per = e.groupBy("schema", "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]), ",").alias("labels"))
    many = e.groupBy("name").agg((F.count_distinct("schema") > 1).alias("ambiguous"))
    return per.join(many, "name").select("schema", "name", "labels", "ambiguous")


def cat_columns_to_write(spark: SparkSession, d: str) -> DataFrame:
    """Columns that rows must give: not generated, numbered or defaulted, but for a constant default in a key."""
    f = frames(spark, SHOP)
    keyed = f["keys"].select("table_name", F.explode("columns").alias("column_name")).distinct().withColumn("keyed", F.lit(True))
    c = f["columns"].join(keyed, ["table_name", "column_name"], "left")
    return c.where("not generated and not sequence and (default_value is null or coalesce(keyed, false))").groupBy("table_name").agg(F.count(F.lit(1)).alias("columns"))


QUERIES |= {"cat_columns": cat_columns, "cat_key_columns": cat_key_columns, "cat_fk_edges": cat_fk_edges, "cat_enum_labels": cat_enum_labels, "cat_columns_to_write": cat_columns_to_write}
SQL |= {
    "cat_columns": """select table_name, ordinal_position::BIGINT as position, column_name, case data_type when 'INTEGER' then 'int' when 'BIGINT' then 'bigint' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' when 'TIMESTAMP' then 'timestamp_ntz' when 'FLOAT[]' then 'array<float>' else data_type end as type
        from information_schema.columns where table_name in (""" + ", ".join(f"'{t}'" for t in TESTDATA) + ")",
    "cat_key_columns": _values([
        ("region", 0, "r_regionkey"), ("nation", 0, "n_nationkey"), ("nation", 1, "n_name"), ("customer", 0, "c_custkey"), ("customer", 1, "c_name"), ("supplier", 0, "s_suppkey"), ("part", 0, "p_partkey"), ("part", 1, "p_name"), ("orders", 0, "o_orderkey"), ("lineitem", 0, "l_orderkey,l_linenumber"),
        ("events", 0, "event_id"), ("documents", 0, "doc_id"), ("documents", 1, "text"), ("labels", 0, "doc_id"), ("embeddings", 0, "vec_id"), ("pages", 0, "page_id"), ("pages", 1, "url"), ("benchmark", 0, "item_id"), ("conversations", 0, "conv_id,turn"),
    ], "table_name VARCHAR, ordinal BIGINT, columns VARCHAR"),
    "cat_fk_edges": _values([("nation", "region", False), ("customer", "nation", False), ("supplier", "nation", False), ("orders", "customer", False), ("lineitem", "orders", False), ("lineitem", "part", False), ("lineitem", "supplier", False), ("events", "customer", False), ("labels", "documents", False)], "child VARCHAR, parent VARCHAR, optional BOOLEAN"),
    "cat_enum_labels": "select schema, name, string_agg(label, ',' order by ord) as labels, name = 'state' as ambiguous from (" + _values(ENUMS, "schema VARCHAR, name VARCHAR, label VARCHAR, ord INTEGER") + ") group by schema, name",
    "cat_columns_to_write": _values([("addresses", 4), ("audit", 3), ("invoices", 4), ("order_items", 4), ("orders", 5), ("orgs", 3), ("payments", 4), ("product_tags", 2), ("products", 3), ("reviews", 5), ("sessions", 4), ("shipments", 4), ("tags", 2), ("users", 3)], "table_name VARCHAR, columns BIGINT"),
}

# Readings of texts: the SQL is the truth table. ------------------------------
CHECKS = [
    ("CHECK ((char_length(name) <= 12))", "length_limit", "name", 12), ("CHECK ((char_length((name)::text) < 13))", "length_limit", "name", 12), ("CHECK ((length(title) <= 255)) NOT VALID", "length_limit", "title", 255),
    ("CHECK ((size > 0))", "lower_bound", "size", 1), ("CHECK ((size >= 3))", "lower_bound", "size", 3), ("CHECK ((0 <= size))", "lower_bound", "size", 0), ("CHECK ((percent <= 100))", "upper_bound", "percent", 100), ("CHECK ((percent < 100))", "upper_bound", "percent", 99),
    ("CHECK ((octet_length(digest) = 20))", "byte_length", "digest", 20), ("CHECK ((octet_length(blob) <= 64))", "byte_limit", "blob", 64), ("CHECK ((char_length(code) >= 4))", "min_length", "code", 4), ("CHECK ((char_length(code) > 4))", "min_length", "code", 5), ("CHECK ((char_length(code) >= 5000))", "unknown", None, None),
    ("CHECK ((cardinality(tags) <= 5))", "cardinality_limit", "tags", 5), ("CHECK ((cardinality(tags) <= 0))", "unknown", None, None), ("CHECK ((note IS NOT NULL))", "not_null", "note", None), ("CHECK (((note IS NULL) OR (size > 2)))", "must_be_null", "note", None), ("CHECK (((note IS NOT NULL) OR (size > 2)))", "not_null", "note", None),
    ("CHECK ((host = lower(host)))", "lowercase", "host", None), ("CHECK ((host = lower(other)))", "unknown", None, None), ("CHECK ((num_nonnulls(a, b) = 1))", "exactly_one", None, None), ("CHECK (((a IS NULL) <> (b IS NULL)))", "exactly_one", "a", None),
    ("CHECK ((num_nonnulls(a, b) = 2))", "all_non_null", None, None), ("CHECK ((num_nonnulls(a, b, c) >= 1))", "at_least_one", None, None), ("CHECK (((a IS NOT NULL) OR (b IS NOT NULL)))", "at_least_one", None, None), ("CHECK ((jsonb_typeof(doc) = 'object'::text))", "json_type", "doc", None),
    ("CHECK ((name <> ''::text))", "non_empty", "name", None), ("CHECK ((state = ANY (ARRAY['on'::text, 'off'::text])))", "value_set", "state", None), ("CHECK ((kind = 'x'::text))", "value_set", "kind", None), ("CHECK ((kind = 3))", "value_set", "kind", None),
    ("CHECK ((slug ~ '^[a-z]+$'::text))", "unknown", None, None), ("CHECK ((a < b))", "unknown", None, None), ("CHECK ((lower(a) = b))", "unknown", None, None), ("CHECK ((a <> 'x'::text))", "unknown", None, None),
]
INDEXES = [
    ("CREATE UNIQUE INDEX i ON t USING btree (a)", "columns", "a"), ("CREATE UNIQUE INDEX i ON t USING btree (a, b DESC)", "columns", "a,b"), ("CREATE UNIQUE INDEX i ON t USING btree (a) WHERE (b IS NULL)", "columns", "a"), ("CREATE UNIQUE INDEX i ON t USING btree (a) INCLUDE (b)", "columns", "a"),
    ("CREATE UNIQUE INDEX i ON t USING btree (lower(a))", "lowered", "a"), ("CREATE UNIQUE INDEX i ON t USING btree (lower((a)::text))", "lowered", "a"), ("CREATE INDEX i ON t USING gin (a jsonb_path_ops)", "harmless", None), ("CREATE INDEX i ON t USING btree (upper(a))", "harmless", None),
    ("CREATE UNIQUE INDEX i ON t USING btree (upper(a))", "unknown", None), ("CREATE INDEX i ON t USING btree (my_function(a))", "unknown", None), ("CREATE UNIQUE INDEX i ON t USING btree (date_trunc('day', a))", "unknown", None),
]
TRIGGERS = [
    ("BEGIN NEW.slug := lower(NEW.name); RETURN NEW; END", False, "slug", ""), ("BEGIN IF NEW.a IS NULL THEN RAISE EXCEPTION 'no'; END IF; RETURN NEW; END", True, "", ""), ("BEGIN RAISE NOTICE 'hello'; RETURN NEW; END", False, "", ""), ("BEGIN NEW.id := nextval('s'); RETURN NEW; END", False, "", ""),
    ("BEGIN SELECT max(n) INTO NEW.n FROM t; RETURN NEW; END", False, "n", ""), ("BEGIN INSERT INTO log(a) VALUES (1); UPDATE stats SET n = n + 1; RETURN NEW; END", False, "", "log,stats"), ("BEGIN ASSERT NEW.a > 0; RETURN NEW; END", True, "", ""), ("BEGIN -- RAISE EXCEPTION\n RETURN NEW; END", False, "", ""),
    ("BEGIN DELETE FROM queue; RAISE WARNING 'RAISE EXCEPTION'; RETURN NEW; END", False, "", "queue"),
]
PARTITIONS = [
    ("HASH (id)", ["FOR VALUES WITH (modulus 2, remainder 0)", "FOR VALUES WITH (modulus 2, remainder 1)"], "anything", None), ("HASH (id)", ["FOR VALUES WITH (modulus 3, remainder 0)", "FOR VALUES WITH (modulus 3, remainder 1)"], "unknown", None),
    ("HASH (id)", ["FOR VALUES WITH (modulus 2, remainder 0)", "FOR VALUES WITH (modulus 4, remainder 1)"], "unknown", None), ("LIST (kind)", ["FOR VALUES IN ('a', 'b')", "FOR VALUES IN ('c')"], "one_of", "a,b,c"), ("LIST (kind)", ["FOR VALUES IN ('a')", "DEFAULT"], "anything", None),
    ("RANGE (at)", ["FOR VALUES FROM ('2020-01-01') TO ('2021-01-01')"], "unknown", None), ("LIST (kind)", [], "unknown", None), ("LIST (lower(kind))", ["FOR VALUES IN ('a')"], "unknown", None),
]


def _texts(spark: SparkSession, rows: list[tuple], n: int) -> DataFrame:
    return spark.createDataFrame([(i, *r[:n]) for i, r in enumerate(rows)], "id long, a string, b array<string>" if n == 2 else "id long, a string")


QUERIES |= {
    "shape_checks": lambda spark, d: _texts(spark, CHECKS, 1).select("id", shapes.check(F.col("a")).alias("r")).select("id", "r.meaning", F.when(F.col("r.column_name") != "", F.col("r.column_name")).alias("column_name"), F.coalesce("r.bound", F.lit(-1)).alias("bound")),
    "shape_indexes": lambda spark, d: _texts(spark, INDEXES, 1).select("id", shapes.index(F.col("a")).alias("r")).select("id", "r.reading", "r.columns"),
    "shape_triggers": lambda spark, d: _texts(spark, TRIGGERS, 1).select("id", shapes.trigger(F.col("a")).alias("r")).select("id", "r.raises", "r.assigns", "r.targets"),
    "shape_partitions": lambda spark, d: _texts(spark, PARTITIONS, 2).select("id", shapes.partition(F.col("a"), F.col("b")).alias("r")).select("id", "r.reading", "r.values"),
}
SQL |= {
    "shape_checks": _values([(i, *r[1:3], -1 if r[3] is None else r[3]) for i, r in enumerate(CHECKS)], "id BIGINT, meaning VARCHAR, column_name VARCHAR, bound BIGINT"),
    "shape_indexes": _values([(i, *r[1:]) for i, r in enumerate(INDEXES)], "id BIGINT, reading VARCHAR, columns VARCHAR"),
    "shape_triggers": _values([(i, *r[1:]) for i, r in enumerate(TRIGGERS)], "id BIGINT, raises BOOLEAN, assigns VARCHAR, targets VARCHAR"),
    "shape_partitions": _values([(i, *r[2:]) for i, r in enumerate(PARTITIONS)], 'id BIGINT, reading VARCHAR, "values" VARCHAR').replace('t(id, reading, "values")', 't(id, reading, "values")'),
}


# Order and refusals ----------------------------------------------------------
def _edges(spark: SparkSession, catalog: Catalog) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = frames(spark, catalog)
    return f["tables"], graph.edges(f["references"], f["tables"]), f["references"]


RINGS: Catalog = {
    t.name: t
    for t in (
        table("a1", "id int, next int null", "id", (), (("next", "a2", "id"),)), table("a2", "id int, next int", "id", (), (("next", "a3", "id"),)), table("a3", "id int, next int", "id", (), (("next", "a1", "id"),)),
        table("b1", "id int, other int", "id", (), (("other", "b2", "id deferrable"),)), table("b2", "id int, other int", "id", (), (("other", "b1", "id deferrable"),)),
        table("c1", "id int, other int", "id", (), (("other", "c2", "id"),)), table("c2", "id int, other int", "id", (), (("other", "c1", "id"),)), table("leaf", "id int, c int", "id", (), (("c", "c1", "id"),)), table("alone", "id int, boss int null", "id", (), (("boss", "alone", "id"),)),
    )
}


def graph_levels(spark: SparkSession, d: str) -> DataFrame:
    tables, edges, _ = _edges(spark, TESTDATA)
    return graph.levels(tables, edges).select("table_name", F.col("level").cast("long").alias("level"))


def graph_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(_edges(spark, TESTDATA)[1])


def graph_dependents(spark: SparkSession, d: str) -> DataFrame:
    ways = graph.closure(_edges(spark, TESTDATA)[1])
    return ways.groupBy(F.col("ancestor").alias("table_name")).agg(F.array_join(F.sort_array(F.collect_set("child")), ",").alias("dependents"))


def graph_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycles(_edges(spark, RINGS)[1])


REFUSED = [("supplier", "unsupported_type")]


def class_contagion(spark: SparkSession, d: str) -> DataFrame:
    """What a table that cannot be filled does to the others."""
    tables, _, references = _edges(spark, TESTDATA)
    return graph.contagion(tables, references, spark.createDataFrame(REFUSED, "table_name string, reason string"))


def class_reasons(spark: SparkSession, d: str) -> DataFrame:
    return class_contagion(spark, d).where("verdict = 'refused'").groupBy("reason").agg(F.count(F.lit(1)).alias("tables"))


def class_reach(spark: SparkSession, d: str) -> DataFrame:
    return class_contagion(spark, d).agg(F.count(F.lit(1)).alias("tables"), F.sum((F.col("verdict") == "filled").cast("int")).cast("long").alias("filled"), F.avg((F.col("verdict") == "filled").cast("double")).alias("reach"))


QUERIES |= {"graph_levels": graph_levels, "graph_ancestors": graph_ancestors, "graph_dependents": graph_dependents, "graph_cycles": graph_cycles, "class_contagion": class_contagion, "class_reasons": class_reasons, "class_reach": class_reach}
_EDGES = f"e as ({SQL['cat_fk_edges']}), w as (with recursive w(child, ancestor) as (select child, parent from e union select w.child, e.parent from w join e on e.child = w.ancestor) select * from w), t as (select unnest([{', '.join(repr(t) for t in TESTDATA)}]) as table_name)"
_CLASS = f"with {_EDGES}, c as (select table_name, case when table_name = 'supplier' then 'unsupported_type' when exists (select 1 from w where child = table_name and ancestor = 'supplier') then 'depends_on_refused' else '' end as reason from t)"
SQL |= {
    "graph_levels": f"with {_EDGES}, l as (with recursive l(table_name, n) as (select table_name, 0 from t union select e.child, l.n + 1 from l join e on e.parent = l.table_name) select * from l) select table_name, max(n)::BIGINT as level from l group by 1",
    "graph_ancestors": f"with {_EDGES} select child, ancestor from w",
    "graph_dependents": f"with {_EDGES} select ancestor as table_name, string_agg(distinct child, ',' order by child) as dependents from w group by 1",
    "graph_cycles": _values([("a1", "a1", "null_then_update"), ("a1", "a2", "null_then_update"), ("a1", "a3", "null_then_update"), ("b1", "b1", "deferred"), ("b1", "b2", "deferred"), ("c1", "c1", "impossible"), ("c1", "c2", "impossible")], "cycle VARCHAR, table_name VARCHAR, strategy VARCHAR").replace("cycle::VARCHAR as cycle", '"cycle"::VARCHAR as "cycle"').replace("t(cycle,", 't("cycle",'),
    "class_contagion": f"{_CLASS} select table_name, case when reason = '' then 'filled' else 'refused' end as verdict, reason from c",
    "class_reasons": f"{_CLASS} select reason, count(*)::BIGINT as tables from c where reason <> '' group by 1",
    "class_reach": f"{_CLASS} select count(*)::BIGINT as tables, count(*) filter (reason = '')::BIGINT as filled, avg((reason = '')::INTEGER::DOUBLE) as reach from c",
}


# Sizes -------------------------------------------------------------------------
TIGHT: Catalog = {
    t.name: t
    for t in (
        table("flags", "on boolean, note text null", "", ("on",)), table("moods", "mood enum(sad|ok|happy)", "", ("mood",)), table("codes", "code varchar(1)", "code"), table("narrow", "on boolean, mood enum(sad|ok|happy)", "on,mood"),
        table("users", "id int, email text", "id", ("email",)), table("roles", "role varchar(8)", "role", (), (), (("role", "role IN ('admin','guest')"),)), table("grants", "user_id int, role varchar(8)", "user_id,role", (), (("user_id", "users", "id"), ("role", "roles", "role"))),
        table("levels", "level int", "level", (), (), (("level", "level >= 1 AND level <= 12"),)), table("opaque", "slug text", "slug", (), (), (("slug", "slug ~ '^[a-z]+$'"),)),
    )
}


def vol_plan(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each table can hold when 50 are asked for."""
    return spark.createDataFrame(sorted(synthesis.sizes(TIGHT, {"users": 20}).items()), "table_name string, rows long")


def vol_capacity(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each key allows; -1: any number."""
    rows = synthesis.sizes(TIGHT, {"users": 20})
    out = [(n, ",".join(k), -1 if (c := synthesis.key_capacity(t, k, rows, synthesis.obliged(t))) is None else c) for n, t in sorted(TIGHT.items()) if n in rows for k in t.keys]
    return spark.createDataFrame(out, "table_name string, key_columns string, capacity long")


def vol_strides(spark: SparkSession, d: str) -> DataFrame:
    rows = synthesis.sizes(TIGHT, {"users": 20})
    out = [(n, c, s) for n in ("grants", "narrow") for c, s in sorted(synthesis.key_strides(TIGHT[n], rows, synthesis.obliged(TIGHT[n])).items())]
    return spark.createDataFrame(out, "table_name string, column_name string, stride long")


def vol_generated(spark: SparkSession, d: str) -> DataFrame:
    """The tight tables, generated: rows, and rows that repeat a key (none)."""
    made = synthesis.generate(spark, TIGHT, {"users": 20}, 3)
    out = None
    for n, df in made.items():
        key = TIGHT[n].keys[0]
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(*key).alias("distinct_keys")).select(F.lit(n).alias("table_name"), "rows", "distinct_keys")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES |= {"vol_plan": vol_plan, "vol_capacity": vol_capacity, "vol_strides": vol_strides, "vol_generated": vol_generated}
_ROWS = [("codes", 36), ("flags", 2), ("grants", 40), ("levels", 12), ("moods", 3), ("narrow", 6), ("roles", 2), ("users", 20)]
SQL |= {
    "vol_plan": _values(_ROWS, "table_name VARCHAR, rows BIGINT"),
    "vol_capacity": _values([("codes", "code", 36), ("flags", "on", 2), ("grants", "user_id,role", 40), ("levels", "level", 12), ("moods", "mood", 3), ("narrow", "on,mood", 6), ("roles", "role", 2), ("users", "id", 2_000_000_000), ("users", "email", -1)], "table_name VARCHAR, key_columns VARCHAR, capacity BIGINT"),
    "vol_strides": _values([("grants", "role", 20), ("grants", "user_id", 1), ("narrow", "mood", 2), ("narrow", "on", 1)], "table_name VARCHAR, column_name VARCHAR, stride BIGINT"),
    "vol_generated": _values([(n, r, r) for n, r in _ROWS], "table_name VARCHAR, rows BIGINT, distinct_keys BIGINT"),
}

# Probe: a regex check is not read, the validator decides on the rows. ------------
PROBED: Catalog = {
    t.name: t
    for t in (
        table("tags", "id bigint, slug text", "id", (), (), (("slug", "slug rlike '^[a-z0-9-]+$'"),)), table("notes", "id bigint, slug text", "id", (), (), (("slug", "slug rlike '^[0-9]+$'"),)),
        table("tag_uses", "id bigint, tag bigint", "id", (), (("tag", "tags", "id"),)), table("note_uses", "id bigint, note bigint", "id", (), (("note", "notes", "id"),)),
    )
}


def probe_rescue(spark: SparkSession, d: str) -> DataFrame:
    """Tables with a check that is not understood are offered anyway: kept if no row breaks a rule."""
    plain = {n: table(n, ", ".join(f"{f.name} {f.type}" for f in t.fields), ",".join(t.primary), (), tuple((",".join(r.columns), r.table, ",".join(r.keys)) for r in t.references)) for n, t in PROBED.items()}
    made = synthesis.generate(spark, plain, dict.fromkeys(plain, 20), 5)
    said = synthesis.probe(made, PROBED)
    return spark.createDataFrame([(n, "refused" if n in said else "rescued", sum(said.get(n, {}).values())) for n in sorted(made)], "table_name string, outcome string, violations long")


# Selection -----------------------------------------------------------------------
PATTERNS = ["*", "o*", "*item", "?ation", "line*", "[a]", "x*", "documents", "*s"]
OVERRIDES = [("*", 10), ("o*", 20), ("orders", 30), ("*s", 40), ("zz*", 50)]


def sel_glob(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame([(x,) for x in PATTERNS], "pattern string")
    t = frames(spark, TESTDATA)["tables"]
    return p.join(F.broadcast(t), F.rlike(F.col("table_name"), shapes.glob(F.col("pattern")))).groupBy("pattern").agg(F.count(F.lit(1)).alias("tables"), F.array_join(F.sort_array(F.collect_list("table_name")), ",").alias("names"))  # a catalog's names


def _matched(spark: SparkSession) -> DataFrame:
    o = spark.createDataFrame([(i, p, n) for i, (p, n) in enumerate(OVERRIDES)], "ordinal long, pattern string, rows long")
    return frames(spark, TESTDATA)["tables"].join(F.broadcast(o), F.rlike(F.col("table_name"), shapes.glob(F.col("pattern"))))


def sel_row_counts(spark: SparkSession, d: str) -> DataFrame:
    """The last override that matches a table counts."""
    return _matched(spark).groupBy("table_name").agg(F.max_by("rows", "ordinal").alias("rows"))


def sel_unmatched(spark: SparkSession, d: str) -> DataFrame:
    o = spark.createDataFrame(OVERRIDES, "pattern string, rows long")
    return o.join(_matched(spark).select("pattern").distinct(), "pattern", "left_anti").select("pattern")


# Surveys ---------------------------------------------------------------------------
def noun_of_columns(spark: SparkSession, d: str) -> DataFrame:
    c = frames(spark, TESTDATA)["columns"].where("type = 'string'")
    return c.select("table_name", "column_name", nouns.noun_of(F.col("table_name"), F.col("column_name")).alias("noun"))


def survey_name_tails(spark: SparkSession, d: str) -> DataFrame:
    """The last words of column names, by how often they occur; the first ten."""
    c = frames(spark, SHOP)["columns"].select(F.element_at(F.split(nouns.snake(F.col("column_name")), "_"), -1).alias("tail"))
    n = c.groupBy("tail").agg(F.count(F.lit(1)).alias("columns"))
    return n.orderBy(F.desc("columns"), "tail").limit(10)


def survey_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Which constructs each catalog has."""
    rows = []
    for name, cat in (("testdata", TESTDATA), ("shop", SHOP), ("rings", RINGS)):
        for t in cat.values():
            rows.append((name, any(len(k) > 1 for k in t.keys), any(f.sequence for f in t.fields), bool(t.checks), bool(t.unique), any(r.table == t.name for r in t.references), any(r.deferrable for r in t.references)))
    names = ("composite_key", "sequence", "check_", "unique_", "self_reference", "deferrable_")
    df = spark.createDataFrame(rows, "catalog string, " + ", ".join(f"{n} boolean" for n in names))
    return df.groupBy("catalog").agg(F.count(F.lit(1)).alias("tables"), *[F.max(n).alias(n) for n in names])


def lit_escape(spark: SparkSession, d: str) -> DataFrame:
    """Rows as text of INSERT statements: names of parts and regions as literals."""
    parts = []
    for table_name, key, name in (("part", "p_partkey", "p_name"), ("region", "r_regionkey", "r_name")):
        literal = shapes.quoted(F.concat(F.col(name), F.lit(" o'clock")))
        parts.append(read(spark, d, table_name).select(F.concat(F.lit(f"INSERT INTO {table_name} VALUES ("), F.col(key).cast("string"), F.lit(", "), literal, F.lit(");")).alias("statement")))
    return parts[0].unionByName(parts[1])


#: Rows that a task takes apart into cells, about, and the most such tasks (more would need memory for their writing).
PROFILE_ROWS, PROFILE_TASKS = 50_000, 200


def profile(df: DataFrame) -> DataFrame:
    """Distinct values, nulls and extremes (as text) of each column; columns must be told apart by their text.

    Equal cells are counted first, by tasks of few rows, so that no task holds
    all columns of a large file. Without rows there are no values and no nulls.
    """
    names = df.columns
    spread = df.repartition(max(1, min(PROFILE_TASKS, -(-df.count() // PROFILE_ROWS))), *names)
    cells = spread.select(F.explode(F.array(*[F.struct(F.lit(n).alias("of"), F.col(n).cast("string").alias("value")) for n in names])).alias("cell")).select("cell.*")
    values = cells.groupBy("of", "value").agg(F.count(F.lit(1)).alias("n"))
    mine = lambda n, x: F.when(F.col("of") == n, F.col(x))
    nulls = lambda n: F.coalesce(F.sum(F.when((F.col("of") == n) & F.col("value").isNull(), F.col("n"))), F.lit(0))
    made = [F.struct(F.lit(n).alias("column_name"), F.count(mine(n, "value")).alias("distinct_values"), nulls(n).alias("nulls"), F.min(mine(n, "value")).alias("least"), F.max(mine(n, "value")).alias("greatest")) for n in names]
    return values.agg(F.array(*made).alias("made")).select(F.explode("made").alias("r")).select("r.*")


def value_profile(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values, nulls and extremes of the columns of customer."""
    return profile(read(spark, d, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)")))


def nth_parent(spark: SparkSession, d: str) -> DataFrame:
    """The three customers with the most orders in each nation (ties by key)."""
    n = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("orders"), "c_custkey"))
    return read(spark, d, "customer").select("c_custkey", "c_nationkey").join(n, "c_custkey").withColumn("place", rank.cast("long")).where("place <= 3").select("c_nationkey", "place", "c_custkey", "orders")


QUERIES |= {
    "probe_rescue": probe_rescue, "sel_glob": sel_glob, "sel_row_counts": sel_row_counts, "sel_unmatched": sel_unmatched, "noun_of_columns": noun_of_columns, "survey_name_tails": survey_name_tails, "survey_coverage": survey_coverage, "lit_escape": lit_escape, "value_profile": value_profile, "top_parents": nth_parent,
}
_T = f"(select unnest([{', '.join(repr(t) for t in TESTDATA)}]) as table_name)"
_O = _values([(i, p, n) for i, (p, n) in enumerate(OVERRIDES)], "ordinal BIGINT, pattern VARCHAR, rows BIGINT")
SQL |= {
    "probe_rescue": _values([("note_uses", "refused", 20), ("notes", "refused", 20), ("tag_uses", "rescued", 0), ("tags", "rescued", 0)], "table_name VARCHAR, outcome VARCHAR, violations BIGINT"),
    "sel_glob": f"select pattern, count(*)::BIGINT as tables, string_agg(table_name, ',' order by table_name) as names from (select unnest([{', '.join(repr(p) for p in PATTERNS if p != '[a]')}]) as pattern) join {_T} on table_name glob pattern group by 1",
    "sel_row_counts": f"select table_name, arg_max(rows, ordinal)::BIGINT as rows from {_T} join ({_O}) on table_name glob pattern group by 1",
    "sel_unmatched": f"select pattern from ({_O}) o where not exists (select 1 from {_T} where table_name glob o.pattern)",
    "noun_of_columns": _values([
        ("region", "r_name", "title"), ("nation", "n_name", "title"), ("customer", "c_name", "person"), ("customer", "c_mktsegment", None), ("supplier", "s_name", "person"), ("part", "p_name", "title"), ("part", "p_brand", None), ("part", "p_type", "mime"), ("orders", "o_orderstatus", "state"), ("orders", "o_orderpriority", None),
        ("lineitem", "l_returnflag", None), ("lineitem", "l_linestatus", None), ("events", "event_type", "mime"), ("events", "props", None), ("documents", "text", "sentence"), ("documents", "lang", "locale"), ("documents", "source", "word"), ("pages", "url", "url"), ("pages", "html", "html"), ("benchmark", "text", "sentence"),
        ("conversations", "role", "scope"), ("conversations", "text", "sentence"),
    ], "table_name VARCHAR, column_name VARCHAR, noun VARCHAR"),
    "survey_name_tails": "select tail, count(*)::BIGINT as columns from (select unnest(split('" + " ".join(f.name.split("_")[-1] for t in SHOP.values() for f in t.fields) + "', ' ')) as tail) group by 1 order by 2 desc, 1 limit 10",
    "survey_coverage": _values([("testdata", 14, True, False, True, True, False, False), ("shop", 14, True, True, True, True, False, False), ("rings", 9, False, False, False, False, True, True)], "catalog VARCHAR, tables BIGINT, composite_key BOOLEAN, sequence BOOLEAN, check_ BOOLEAN, unique_ BOOLEAN, self_reference BOOLEAN, deferrable_ BOOLEAN"),
    "lit_escape": " union all ".join(f"select 'INSERT INTO {t} VALUES (' || {k} || ', ''' || replace({n} || ' o''clock', '''', '''''') || ''');' as statement from {t}" for t, k, n in (("part", "p_partkey", "p_name"), ("region", "r_regionkey", "r_name"))),
    "value_profile": " union all ".join(f"select '{c}' as column_name, count(distinct {c})::BIGINT as distinct_values, count(*) filter ({c} is null)::BIGINT as nulls, min({c}::VARCHAR) as least, max({c}::VARCHAR) as greatest from (select * replace (c_acctbal::DECIMAL(18,2) as c_acctbal) from customer)" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
    "top_parents": "select c_nationkey, place, c_custkey, orders from (select c_nationkey, c_custkey, n as orders, row_number() over (partition by c_nationkey order by n desc, c_custkey) as place from customer join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey) where place <= 3",
}


# Indexes, references that share columns, reports, statements ---------------------------
OWNED = [("users_pkey", "users", "CREATE UNIQUE INDEX users_pkey ON users USING btree (id)", True), ("users_email", "users", "CREATE UNIQUE INDEX users_email ON users USING btree (lower(email))", False), ("orders_at", "orders", "CREATE INDEX orders_at ON orders USING btree (placed)", False), ("tags_slug", "tags", "CREATE UNIQUE INDEX tags_slug ON tags USING btree (upper(label))", False)]
SHARED: Catalog = {
    t.name: t
    for t in (
        table("tenants", "id int", "id"), table("people", "tenant int, id int", "tenant,id", (), (("tenant", "tenants", "id"),)), table("rooms", "tenant int, id int", "tenant,id", (), (("tenant", "tenants", "id"),)),
        table("bookings", "id int, tenant int, person int, room int", "id", (), (("tenant,person", "people", "tenant,id"), ("tenant,room", "rooms", "tenant,id"))), table("notes", "id int, tenant int, person int", "id", (), (("tenant", "tenants", "id"), ("tenant,person", "people", "tenant,id"))),
    )
}


def index_obligations(spark: SparkSession, d: str) -> DataFrame:
    """What the indexes that no constraint owns ask of their tables: a key, a key in lower case, nothing, or not read."""
    i = spark.createDataFrame(OWNED, "index_name string, table_name string, definition string, owned boolean")
    owned = i.where("owned").select("index_name")
    r = i.join(owned, "index_name", "left_anti").withColumn("r", shapes.index(F.col("definition")))
    asks = F.when(F.col("r.reading") == "columns", "unique").when(F.col("r.reading") == "lowered", "unique in lower case").when(F.col("r.reading") == "harmless", "nothing").otherwise("not read")
    return r.select("index_name", "table_name", asks.alias("asks"))


def class_entangled(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of references of a table that share a column, and whether the wider one has all of the other."""
    r = frames(spark, SHARED)["references"].select("table_name", "ordinal", "columns", "parent")
    a, b = r.alias("a"), r.alias("b")
    pairs = a.join(b, (F.col("a.table_name") == F.col("b.table_name")) & (F.col("a.ordinal") < F.col("b.ordinal")) & F.arrays_overlap("a.columns", "b.columns"))
    covered = (F.size(F.array_except("a.columns", "b.columns")) == 0) | (F.size(F.array_except("b.columns", "a.columns")) == 0)
    return pairs.select(F.col("a.table_name").alias("table_name"), F.col("a.parent").alias("first_parent"), F.col("b.parent").alias("second_parent"), covered.alias("covered"))


def rep_outcome(spark: SparkSession, d: str) -> DataFrame:
    """The report of a run: each table filled with how many rows, fewer than asked for or not, or refused."""
    rows = synthesis.sizes(TIGHT, {"users": 20})
    made = [(n, "filled" if n in rows else "refused", rows.get(n, 0), rows.get(n, 0) < ({"users": 20}.get(n, 50)) and n in rows) for n in sorted(TIGHT)]
    return spark.createDataFrame(made, "table_name string, outcome string, rows long, capped boolean")


def insert_statements(spark: SparkSession, d: str) -> DataFrame:
    """A table as INSERT statements, a line each: numbers bare, texts quoted, nulls as NULL."""
    return shapes_of_rows(read(spark, d, "nation"), "nation")


def shapes_of_rows(df: DataFrame, name: str) -> DataFrame:
    """The rows of a table as INSERT statements; ``write.text`` puts them into files."""
    texts = {f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "date", "timestamp", "timestamp_ntz")}
    values = [F.coalesce(shapes.quoted(F.col(c).cast("string")) if c in texts else F.col(c).cast("string"), F.lit("NULL")) for c in df.columns]
    return df.select(F.concat(F.lit(f'INSERT INTO "{name}" ({", ".join(chr(34) + c + chr(34) for c in df.columns)}) VALUES ('), F.concat_ws(", ", *values), F.lit(");")).alias("statement"))


QUERIES |= {"index_obligations": index_obligations, "class_entangled": class_entangled, "rep_outcome": rep_outcome, "lit_insert": insert_statements}
SQL |= {
    "index_obligations": _values([("users_email", "users", "unique in lower case"), ("orders_at", "orders", "nothing"), ("tags_slug", "tags", "not read")], "index_name VARCHAR, table_name VARCHAR, asks VARCHAR"),
    "class_entangled": _values([("bookings", "people", "rooms", False), ("notes", "tenants", "people", True)], "table_name VARCHAR, first_parent VARCHAR, second_parent VARCHAR, covered BOOLEAN"),
    "rep_outcome": _values([("codes", "filled", 36, True), ("flags", "filled", 2, True), ("grants", "filled", 40, True), ("levels", "filled", 12, True), ("moods", "filled", 3, True), ("narrow", "filled", 6, True), ("opaque", "refused", 0, False), ("roles", "filled", 2, True), ("users", "filled", 20, False)], "table_name VARCHAR, outcome VARCHAR, rows BIGINT, capped BOOLEAN"),
    "lit_insert": """select 'INSERT INTO "nation" ("n_nationkey", "n_name", "n_regionkey") VALUES (' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''', ' || n_regionkey || ');' as statement from nation""",
}


# Obligations and refusals -------------------------------------------------------------
#: A table for each meaning of a check, and what its rows have to satisfy in Spark's SQL.
OBLIGED: Catalog = {
    t.name: t
    for t in (
        table("between", "id int, n int, m int", "id", (), (), (("n", "CHECK (((n >= 3) AND (n <= 9)))"), ("m", "CHECK ((m > 100))"))),
        table("bytes", "id int, code text", "id", (), (), (("code", "CHECK ((octet_length(code) = 20))"),)),
        table("worded", "id int, word text", "id", (), (), (("filled", "CHECK ((word <> ''::text))"), ("low", "CHECK ((word = lower(word)))"), ("short", "CHECK ((char_length(word) <= 30))"), ("long", "CHECK ((length(word) > 9))"))),
        table("listed", "id int, state text, level int", "id", (), (), (("state", "CHECK (((state)::text = ANY ((ARRAY['it''s'::character varying, 'b'::character varying])::text[])))"), ("level", "level IN (1, 2, 30)"))),
        table("single", "id int, a int null, b int null, c int null", "id", (), (), (("one", "CHECK ((num_nonnulls(a, b, c) = 1))"),)),
        table("counted", "id int, a int null, b int null", "id", (), (), (("some", "CHECK ((num_nonnulls(a, b) > 0))"), ("both", "CHECK ((num_nonnulls(a, b) = 2))"))),
        table("typed", "id int, doc jsonb", "id", (), (), (("doc", "CHECK ((jsonb_typeof(doc) = 'array'::text))"),)),
        table("tagged", "id int, tags text[]", "id", (), (), (("few", "CHECK ((cardinality(tags) <= 3))"),)),
        table("gone", "id int, until int null", "id", (), (), (("until", "CHECK (((until IS NULL) OR (until > 5)))"),)),
    )
}
HOLDS = {
    "between": "n between 3 and 9 and m > 100", "bytes": "octet_length(code) = 20", "worded": "word <> '' and word = lower(word) and char_length(word) between 10 and 30", "listed": "state in ('it\\'s', 'b') and level in (1, 2, 30)",
    "single": "int(a is not null) + int(b is not null) + int(c is not null) = 1", "counted": "a is not null and b is not null", "typed": "doc like '[%'", "tagged": "size(tags) <= 3", "gone": "until is null or until > 5",
}
UNFILLED: Catalog = {
    t.name: t
    for t in (
        table("apart", "id int, a int", "id", (), (), (("low", "a >= 5 AND a <= 3"),)), table("narrow", "id int, a varchar(3)", "id", (), (), (("long", "char_length(a) >= 9"),)), table("unread", "id int, a text", "id", (), (), (("shape", "a ~ '^[a-z]+$'"),)),
        table("unfit", "id int, a varchar(2)", "id", (), (), (("set", "a IN ('abc', 'def')"),)), table("never", "id int, a int", "id", (), (), (("null", "CHECK (((a IS NULL) OR (a > 5)))"),)), table("child", "id int, p int", "id", (), (("p", "unread", "id"),)),
        table("lost", "id int, p int", "id", (), (("p", "elsewhere", "id"),)), table("egg", "id int, p int", "id", (), (("p", "hen", "id"),)), table("hen", "id int, p int", "id", (), (("p", "egg", "id"),)), table("plain", "id int, p int null", "id", (), (("p", "unread", "id"),)),
    )
}


def gen_obligations(spark: SparkSession, d: str) -> DataFrame:
    """Generated rows of a table for each meaning of a check, and how many of them break it."""
    made = synthesis.generate(spark, OBLIGED, {}, 5)
    out = None
    for n, df in sorted(made.items()):
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.expr(HOLDS[n]), 0).otherwise(1)).cast("long").alias("violations")).select(F.lit(n).alias("table_name"), "rows", "violations")
        out = one if out is None else out.unionByName(one)
    return out


def class_refusals(spark: SparkSession, d: str) -> DataFrame:
    """The tables that are refused, each with its reason."""
    return spark.createDataFrame(sorted(synthesis.refusals(UNFILLED).items()), "table_name string, reason string")


QUERIES |= {"gen_obligations": gen_obligations, "class_refusals": class_refusals}
SQL |= {
    "gen_obligations": _values([(n, 50, 0) for n in sorted(OBLIGED)], "table_name VARCHAR, rows BIGINT, violations BIGINT"),
    "class_refusals": _values([
        ("apart", "checks on a leave no value"), ("narrow", "checks on a leave no value"), ("unread", "check shape is not read"), ("unfit", "checks on a leave no value"), ("never", "a must be null and must not"), ("child", "needs unread, which is refused"),
        ("lost", "needs elsewhere, which is not in the catalog"), ("egg", "in or above a cycle of required references"), ("hen", "in or above a cycle of required references"),
    ], "table_name VARCHAR, reason VARCHAR"),
}


# Cycles, bound catalogs, selection with parents ------------------------------------------
def repair_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Tables in cycles: rows, rows without a reference, and references that no parent has."""
    made = synthesis.generate(spark, RINGS, {"b2": 20, "a3": 7}, 11)
    out = None
    for n, df in made.items():
        (ref,) = RINGS[n].references
        lost = validate.orphans(df, ref, made[ref.table]).agg(F.count(F.lit(1)).alias("orphans"))
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(ref.columns[0]).isNull()).alias("roots")).crossJoin(lost).select(F.lit(n).alias("table_name"), "rows", "roots", "orphans")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


#: Tables with indexes, triggers and partitions that ask something of their rows.
BOUND: Catalog = {
    t.name: t
    for t in (
        replace(table("hosts", "id int, name text, note text", "id"), indexes=("CREATE UNIQUE INDEX hosts_name ON hosts USING btree (lower(name))", "CREATE INDEX hosts_note ON hosts USING btree (note)")),
        replace(table("pairs", "id int, a boolean, b boolean", "id"), indexes=("CREATE UNIQUE INDEX pairs_ab ON pairs USING btree (a, b)",)),
        replace(table("odd", "id int, a text", "id"), indexes=("CREATE UNIQUE INDEX odd_a ON odd USING btree (upper(a))",)),
        replace(table("kinds", "id int, kind text", "id"), partition=("LIST (kind)", ("FOR VALUES IN ('a', 'b')", "FOR VALUES IN ('c')"))),
        replace(table("ranges", "id int, at date", "id"), partition=("RANGE (at)", ("FOR VALUES FROM ('2020-01-01') TO ('2021-01-01')",))),
        replace(table("strict", "id int, a int", "id"), triggers=(("look", "BEGIN IF NEW.a IS NULL THEN RAISE EXCEPTION 'no'; END IF; RETURN NEW; END"),)),
        replace(table("slugs", "id int, slug text", "id"), triggers=(("slugify", "BEGIN NEW.slug = lower(NEW.slug); RETURN NEW; END"),)),
        replace(table("quiet", "id bigint sequence, a int", "id"), triggers=(("count", "BEGIN NEW.id := nextval('s'); RETURN NEW; END"),)),
        replace(table("told", "id int", "id"), triggers=(("tell", "BEGIN INSERT INTO Log(a) VALUES (1); RETURN NEW; END"),)),
        replace(table("away", "id int", "id"), triggers=(("send", "BEGIN UPDATE elsewhere SET n = n + 1; RETURN NEW; END"),)),
        table("log", "a int", "a"), table("uses", "id int, o int", "id", (), (("o", "odd", "id"),)),
    )
}


def class_bound(spark: SparkSession, d: str) -> DataFrame:
    """What indexes, triggers and partitions do to tables: rows made, or why there are none."""
    rows, why = synthesis.sizes(BOUND, {}), synthesis.refusals(BOUND)
    return spark.createDataFrame([(n, rows.get(n, 0), why.get(n)) for n in sorted(BOUND)], "table_name string, rows long, reason string")


def gen_bound(spark: SparkSession, d: str) -> DataFrame:
    """Generated rows of tables with bound indexes and partitions, and how many break what these ask."""
    made = synthesis.generate(spark, BOUND, {}, 3)
    asks = {"hosts": ("name = lower(name)", ("name",)), "pairs": ("true", ("a", "b")), "kinds": ("kind in ('a', 'b', 'c')", ("id",))}
    out = None
    for n, (holds, key) in asks.items():
        one = made[n].agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(*key).alias("distinct_keys"), F.count_if(~F.expr(holds)).alias("violations")).select(F.lit(n).alias("table_name"), "rows", "distinct_keys", "violations")
        out = one if out is None else out.unionByName(one)
    return out


INCLUDE, EXCLUDE = ["orders", "l*", "e*s"], ["embed*", "region"]


def sel_pulled(spark: SparkSession, d: str) -> DataFrame:
    """The tables that patterns ask for, and the parents that come along, but for those excluded."""
    tables, edges, _ = _edges(spark, TESTDATA)
    return graph.selection(tables, edges, spark.createDataFrame([(p,) for p in INCLUDE], "pattern string"), spark.createDataFrame([(p,) for p in EXCLUDE], "pattern string"))


QUERIES |= {"repair_cycle": repair_cycle, "class_bound": class_bound, "gen_bound": gen_bound, "sel_pulled": sel_pulled}
_INCLUDE, _EXCLUDE = (f"(select unnest([{', '.join(repr(p) for p in patterns)}]) as pattern)" for patterns in (INCLUDE, EXCLUDE))
SQL |= {
    "repair_cycle": _values([("a1", 50, 1, 0), ("a2", 50, 0, 0), ("a3", 7, 0, 0), ("alone", 50, 1, 0), ("b1", 50, 0, 0), ("b2", 20, 0, 0)], "table_name VARCHAR, rows BIGINT, roots BIGINT, orphans BIGINT"),
    "class_bound": _values([
        ("hosts", 50, None), ("pairs", 4, None), ("odd", 0, "index odd_a is not read"), ("kinds", 50, None), ("ranges", 0, "its partitions are not read"), ("strict", 0, "trigger look may raise"), ("slugs", 0, "trigger slugify sets slug"), ("quiet", 50, None),
        ("told", 50, None), ("away", 0, "trigger send writes elsewhere"), ("log", 0, "trigger tell writes log"), ("uses", 0, "needs odd, which is refused"),
    ], "table_name VARCHAR, rows BIGINT, reason VARCHAR"),
    "gen_bound": _values([("hosts", 50, 50, 0), ("pairs", 4, 4, 0), ("kinds", 50, 50, 0)], "table_name VARCHAR, rows BIGINT, distinct_keys BIGINT, violations BIGINT"),
    "sel_pulled": f"with {_EDGES}, x as (select table_name from t where exists (select 1 from {_EXCLUDE} where table_name glob pattern)), q as (select table_name from t where exists (select 1 from {_INCLUDE} where table_name glob pattern) and table_name not in (select table_name from x)) select table_name, 'asked' as how from q union all select distinct ancestor, 'needed' from w where child in (select table_name from q) and ancestor not in (select table_name from q) and ancestor not in (select table_name from x)",
}
