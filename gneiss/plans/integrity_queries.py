"""Queries of integrity beyond single constraints: routing, spelled checks, type fit, probing, drawing and repairing references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, nouns, types
from ..operators import foreign_keys, probing, validate
from ..operators.routing import Parted, routed
from ..sources.catalog import TESTDATA, Field, Table, table
from ..sources.shared import read
from ..sources.statements import inserts
from . import synthesis

SEED = 7

#: How three tables could be partitioned, and the key that is added up as a check of which rows a part has.
PARTED = {
    "lineitem": (Parted("RANGE (l_shipdate)", tuple((f"y{y}", f"FOR VALUES FROM ('{y}-01-01 00:00:00') TO ('{y + 1}-01-01 00:00:00')") for y in (1997, 1992, 1993, 1995, 1996)) + (("later", "FOR VALUES FROM ('1998-06-01') TO (MAXVALUE)"),)), "l_partkey"),
    "orders": (Parted("LIST (o_orderstatus)", (("done", "FOR VALUES IN ('F'::text)"), ("open", "FOR VALUES IN ('O', NULL)"))), "o_orderkey"),
    "events": (Parted("HASH (event_id)", (("e0", "FOR VALUES WITH (modulus 4, remainder 0)"), ("e1", "FOR VALUES WITH (modulus 4, remainder 1)"), ("e2", "FOR VALUES WITH (modulus 8, remainder 2)"), ("e3", "FOR VALUES WITH (modulus 4, remainder 3)"))), "event_id"),
}


def partition_routing(spark: SparkSession, d: str) -> DataFrame:
    """The rows of each part of three tables, and those that no part takes."""
    parts = []
    for name, (parted, key) in PARTED.items():
        rows = routed(read(spark, d, name), parted).groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(key)).cast("long").alias("keys"))
        parts.append(rows.select(F.lit(name).alias("table_name"), F.coalesce("part", F.lit("no part")).alias("part"), "rows", "keys"))
    return reduce(DataFrame.unionByName, parts)


#: Checks of the test data as a catalog prints them: table, name, text, the same in the SQL of DuckDB.
SPELLED = [
    ("customer", "acctbal", "CHECK ((c_acctbal >= (0)::double precision))", "c_acctbal >= 0"),
    ("customer", "segment", "CHECK (((c_mktsegment)::text = ANY ((ARRAY['AUTOMOBILE'::character varying, 'BUILDING'::character varying, 'FURNITURE'::character varying, 'HOUSEHOLD'::character varying, 'MACHINERY'::character varying])::text[])))", "c_mktsegment in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')"),
    ("customer", "named", "CHECK (((c_name)::text ~ '^Customer#[0-9]+$'::text))", "regexp_matches(c_name, '^Customer#[0-9]+$')"),
    ("part", "size", "CHECK (((p_size >= 1) AND (p_size <= 50)))", "p_size between 1 and 50"),
    ("part", "brand", "CHECK (((p_brand)::text ~~ 'Brand#%'::text)) NOT VALID", "p_brand like 'Brand#%'"),
    ("part", "small_or_dear", "CHECK (((p_size < 10) OR (p_retailprice > (1000)::double precision) OR (p_type IS NULL)))", "p_size < 10 or p_retailprice > 1000 or p_type is null"),
    ("orders", "status", "CHECK (((o_orderstatus = 'F'::text) OR (o_orderstatus = 'O'::text)))", "o_orderstatus = 'F' or o_orderstatus = 'O'"),
    ("orders", "from", "CHECK ((o_orderdate >= '1994-01-01 00:00:00'::timestamp without time zone))", "o_orderdate >= timestamp '1994-01-01'"),
    ("orders", "not_urgent", "CHECK ((o_orderpriority <> ALL (ARRAY['1-URGENT'::text, '5-LOW'::text])))", "o_orderpriority not in ('1-URGENT', '5-LOW')"),
    ("lineitem", "flags", "CHECK (((l_returnflag = 'R'::text) <> (l_linestatus = 'O'::text)))", "(l_returnflag = 'R') <> (l_linestatus = 'O')"),
    ("lineitem", "price", "CHECK ((((l_extendedprice * ((1)::double precision - l_discount)) * ((1)::double precision + l_tax)) > (5000)::double precision))", "l_extendedprice * (1 - l_discount) * (1 + l_tax) > 5000"),
    ("events", "props", "CHECK ((jsonb_typeof((props)::jsonb) = 'object'::text))", "ltrim(props) like '{%'"),
    ("events", "kind", "CHECK (((event_type ~* '^(CLICK|VIEW)$'::text) OR (value IS NOT NULL)))", "lower(event_type) in ('click', 'view') or value is not null"),
    ("documents", "one_name", "CHECK ((num_nonnulls(lang, source) = 2))", "lang is not null and source is not null"),
    ("documents", "long", "CHECK ((char_length(text) <= 2000))", "length(text) <= 2000"),
    ("documents", "lang", "CHECK (((lang = lower(lang)) AND (NOT (lang = ANY (ARRAY['fr'::text])))))", "lang = lower(lang) and not lang in ('fr')"),
    ("pages", "url", "CHECK ((\"left\"(url, 4) = 'http'::text))", "left(url, 4) = 'http'"),
    ("labels", "not_both", "CHECK ((NOT ((quality = 1) AND (toxic = 1))))", "not (quality = 1 and toxic = 1)"),
    ("embeddings", "length", "CHECK ((cardinality(embedding) <= 64))", "len(embedding) <= 64"),
]


def check_spelled(spark: SparkSession, d: str) -> DataFrame:
    """Violations of checks in a catalog's spelling, one pass over each table."""
    parts = []
    for name in dict.fromkeys(t for t, *_ in SPELLED):
        t = Table(name, (), checks=tuple((check, text) for of, check, text, _ in SPELLED if of == name))
        parts.append(validate.scanned(read(spark, d, name), t))
    return reduce(DataFrame.unionByName, parts).select("table_name", F.split("constraint_name", ":")[1].alias("check_name"), "violations")


#: Types that the test data could be declared with; some are too narrow.
DECLARED = {
    "region": {"r_regionkey": "smallint", "r_name": "varchar(8)"},
    "nation": {"n_nationkey": "smallint", "n_name": "char(8)", "n_regionkey": "int"},
    "customer": {"c_custkey": "int", "c_name": "varchar(18)", "c_nationkey": "smallint", "c_acctbal": "numeric(6,2)", "c_mktsegment": "enum(AUTOMOBILE|BUILDING|FURNITURE|HOUSEHOLD)"},
    "supplier": {"s_suppkey": "smallint", "s_name": "varchar(30)", "s_acctbal": "numeric(5,2)"},
    "part": {"p_partkey": "smallint", "p_name": "varchar(12)", "p_brand": "char(10)", "p_size": "smallint", "p_retailprice": "numeric(5,1)"},
    "orders": {"o_orderkey": "smallint", "o_orderstatus": "char", "o_totalprice": "numeric(7,2)", "o_orderdate": "date", "o_orderpriority": "varchar(8)"},
    "lineitem": {"l_orderkey": "bigint", "l_linenumber": "smallint", "l_quantity": "smallint", "l_extendedprice": "int", "l_discount": "numeric(2,2)", "l_returnflag": "boolean", "l_shipdate": "timestamp"},
    "events": {"event_id": "smallint", "event_type": "enum(click|view|purchase)", "value": "numeric(4,2)", "props": "jsonb", "ts": "timestamp"},
    "documents": {"doc_id": "int", "text": "varchar(1000)", "lang": "char(2)", "source": "varchar(4)", "n_chars": "smallint"},
    "labels": {"doc_id": "smallint", "quality": "smallint", "toxic": "boolean"},
    "embeddings": {"vec_id": "int", "embedding": "real[]", "label": "smallint"},
    "pages": {"page_id": "int", "url": "varchar(30)", "html": "text"},
    "benchmark": {"item_id": "int", "text": "varchar(200)"},
    "conversations": {"conv_id": "int", "turn": "smallint", "role": "enum(user|assistant)", "text": "varchar(80)"},
}


def type_fit(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each column do not go into its declared type; one pass over each table."""
    parts = [types.misfits(read(spark, d, name), {c: types.read(k) for c, k in columns.items()}).select(F.lit(name).alias("table_name"), "column_name", "misfits") for name, columns in DECLARED.items()]
    return reduce(DataFrame.unionByName, parts)


def probe_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every table offered in order and written once: its rows, how many rules it breaks with how many violations, kept or not."""
    said = [(v.table, v.rows, len(v.broken), sum(v.broken.values()), v.kept is not None) for v in probing.offered(((n, read(spark, d, n)) for n in TESTDATA), TESTDATA)]
    return spark.createDataFrame(said, "table_name string, rows long, rules_broken long, violations long, kept boolean")


def fk_draw_shared(spark: SparkSession, d: str) -> DataFrame:
    """For each order a customer and a supplier of one nation, all pairs of a nation in turn."""
    orders = read(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("row"))
    customers = read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    suppliers = read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    return foreign_keys.drawn_shared(orders, customers, suppliers, ["nation"], (["c_custkey"], ["s_suppkey"]))


def gen_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """For each line the moments of its order's customer, its order and itself: opened one after the other, worked out from its own key."""
    n = read(spark, d, "customer").count()
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    order = F.col("l_orderkey").cast("long")
    owner = foreign_keys.parent_row(order, n)
    opened = {name: nouns.moment(owner, F.lit(0), "opened", depth) for depth, name in enumerate(("customer_opened", "order_opened", "line_opened"))}
    touched = nouns.moment(owner, cells.cell(SEED, "lineitem", "touched", order), "touched", 2)
    return lines.select("l_orderkey", "l_linenumber", *[m.alias(name) for name, m in opened.items()], touched.alias("line_touched"))


def repair_lowest_other(spark: SparkSession, d: str) -> DataFrame:
    """Nations in a ring with suppliers: all but the least nation refer to the least supplier key other than their own."""
    nations = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"))
    return foreign_keys.repaired(nations, "n_nationkey", "lead", read(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey")), "s_suppkey").select("n_nationkey", F.coalesce("lead", F.lit(-1)).alias("lead"))


#: Tables whose keys have few values, whose checks leave little room, or whose references lean on each other.
SOUND = {
    t.name: t
    for t in (
        table("days", "day date, note text", "day"),
        table("spans", "span interval, n smallint", "span", (), (), (("n", "n <= -5"),)),
        table("shorts", "id smallint, price numeric(4,2)", "id", ("price",), (), (("price", "price >= 5"),)),
        table("codes", "code numeric(3,0), low double, level double", "code", (), (), (("low", "low <= -5"), ("level", "level >= 5 AND level <= 5"))),
        table("tenants", "id int, kind numeric(4,1), open date", "id", (), (), (("kind", "kind IN (1, 2.5, 40)"), ("open", "open IN ('2024-02-29', '2023-01-01')"))),
        table("users", "tenant_id int, id int, token bytea", "tenant_id,id", ("token",), (("tenant_id", "tenants", "id"),), (("token", "octet_length(token) = 20"),)),
        table("posts", "id bigint, tenant_id int, user_id int, by_user text null, by_bot text null", "id", (), (("tenant_id", "tenants", "id"), ("tenant_id,user_id", "users", "tenant_id,id")), (("one", "num_nonnulls(by_user, by_bot) = 1"),)),
        table("rooms", "tenant_id int, id int", "tenant_id,id", (), (("tenant_id", "tenants", "id"),)),
        table("bookings", "id int, tenant_id int, user_id int, room_id int", "id", (), (("tenant_id,user_id", "users", "tenant_id,id"), ("tenant_id,room_id", "rooms", "tenant_id,id"))),
        table("widths", "id int, place point", "id"),
    )
}


def gen_sound(spark: SparkSession, d: str) -> DataFrame:
    """As many rows of each table as there are orders, or as its keys have values; violations of all constraints and types; refused ones have none."""
    n = read(spark, d, "orders").count()
    made = synthesis.generate(spark, SOUND, dict.fromkeys(SOUND, n), SEED)
    broken = validate.report({name: SOUND[name] for name in made}, lambda name: made[name]).groupBy("table_name").agg(F.sum("violations").cast("long").alias("violations"))
    wrong = reduce(DataFrame.unionByName, [types.misfits(df, {f.name: SOUND[name].kind(f.name) for f in SOUND[name].fields}).agg(F.sum("misfits").alias("misfits")).select(F.lit(name).alias("table_name"), "misfits") for name, df in made.items()])
    counts = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in made.items()])
    every = spark.createDataFrame([(name,) for name in SOUND], "table_name string")
    none = F.lit(0).cast("long")
    return every.join(counts, "table_name", "left").join(broken, "table_name", "left").join(wrong, "table_name", "left").select("table_name", F.coalesce("rows", none).alias("rows"), F.coalesce("violations", none).alias("violations"), F.coalesce("misfits", none).alias("misfits"))


#: A table of nested and derived types; the domain's own check bounds the entries of its arrays.
NESTED = Table(
    "nested", (Field("id", "bigint"), Field("grid", "int[][]"), Field("codes", "percent[]"), Field("share", "percent"), Field("states", "enum(new|old|gone)[]", True), Field("shape", "polygon", True)), ("id",),
    domains=(("positive", "int", ("VALUE > 0",)), ("percent", "positive", ("VALUE <= 100",))),
)


def gen_nested(spark: SparkSession, d: str) -> DataFrame:
    """Nested columns for each order, by the expressions of the generator; an unknown type that may be null is null."""
    made = synthesis.plans({"nested": NESTED}, {"nested": 1}, SEED)["nested"]
    rows = read(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("row"))
    c = {name: make(F.col("row")) for name, make in made.columns.items()}
    return rows.select("row", c["id"].alias("id"), F.size(c["grid"]).alias("outer"), F.size(c["grid"][0]).alias("inner"), c["grid"][0][0].alias("cell"), c["codes"][0].alias("code"), c["share"].alias("share"), c["states"][0].alias("state"), c["shape"].isNull().alias("no_shape"))


def lit_events(spark: SparkSession, d: str) -> DataFrame:
    """Every event as an INSERT statement of one row."""
    return inserts(read(spark, d, "events").select("event_id", "event_type", "props"), "events", rows=1)


QUERIES = {
    "lit_events": lit_events,
    "v_partition_routing": partition_routing, "v_check_spelled": check_spelled, "v_type_fit": type_fit, "probe_tables": probe_tables, "fk_draw_shared": fk_draw_shared, "gen_lifecycle": gen_lifecycle, "repair_lowest_other": repair_lowest_other, "gen_sound": gen_sound, "gen_nested": gen_nested,
}


def _fit_sql(name: str, column: str, kind: types.Kind) -> str:
    """Does a value fit, in DuckDB: written for the types of DECLARED one by one."""
    held = {f.name: f.type for f in TESTDATA[name].fields}[column]
    text, c = held == "string", column
    if kind.name in types.LIMITS:
        low, high = types.LIMITS[kind.name]
        return f"({c} between {low} and {high} and {c} = floor({c}))" if not text else "false"
    if kind.name == "numeric":
        return f"abs(round({c}, {kind.scale})) < 1e{kind.precision - kind.scale}"
    if kind.name in ("varchar", "char"):
        return f"length(rtrim({c})) <= {kind.length}" if kind.length else "true"
    if kind.name == "enum":
        return f"{c} in ({', '.join(repr(x) for x in kind.labels)})"
    if kind.name == "boolean":
        return f"lower({c}) in ('t', 'true', 'y', 'yes', '1', 'f', 'false', 'n', 'no', '0')" if text else "true"
    return {"jsonb": f"json_valid({c})"}.get(kind.name, "true")


def _probe_sql() -> str:
    """Violations table by table, in order; a reference to a table that is not kept fails for each row that has it."""
    ctes = []
    for t in TESTDATA.values():
        n, rules = t.name, []
        rules += [f"select count(*) as n from {n} where {f.name} is null" for f in t.fields if not f.nullable]
        rules += [f"select count(*) as n from {n} where ({text.replace('char_length', 'length')}) is false" for _, text in t.checks]
        rules += [f"select count(*) as n from (select 1 from {n} where {' and '.join(f'{c} is not null' for c in key)} group by {', '.join(key)} having count(*) > 1)" for key in t.keys]
        for r in t.references:
            (c,), (k,) = r.columns, r.keys
            rules.append(f"select count(*) as n from {n} x where x.{c} is not null and not ((select kept from k_{r.table}) and exists (select 1 from {r.table} y where y.{k} = x.{c}))")
        ctes.append(f"k_{n} as (select '{n}' as table_name, (select count(*) from {n})::BIGINT as rows, count(*) filter (n > 0)::BIGINT as rules_broken, coalesce(sum(n), 0)::BIGINT as violations, coalesce(sum(n), 0) = 0 as kept from ({' union all '.join(rules)}))")
    return f"with {', '.join(ctes)} {' union all '.join(f'select * from k_{n}' for n in TESTDATA)}"


_YEARS = "case when year(l_shipdate) in (1992, 1993, 1995, 1996, 1997) then 'y' || year(l_shipdate)::VARCHAR when l_shipdate >= timestamp '1998-06-01' then 'later' else 'no part' end"
_REST = "('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT"
_ANCHOR = f"(r * {nouns.LIFETIME_STEP} % {nouns.LIFETIMES})"
_CELL = "('0x' || substr(md5('7/nested/{0}/' || r::VARCHAR), 1, 15))::BIGINT"

SQL = {
    "lit_events": """select 'INSERT INTO "events" ("event_id", "event_type", "props") VALUES' || chr(10) || '(' || event_id || ', ' || coalesce('''' || replace(event_type, '''', '''''') || '''', 'NULL') || ', ' || coalesce('''' || replace(props, '''', '''''') || '''', 'NULL') || ');' as statement from events""",
    "v_partition_routing": f"""
        select 'lineitem' as table_name, {_YEARS} as part, count(*)::BIGINT as rows, sum(l_partkey)::BIGINT as keys from lineitem group by 2
        union all select 'orders', case when o_orderstatus = 'F' then 'done' when o_orderstatus = 'O' or o_orderstatus is null then 'open' else 'no part' end, count(*)::BIGINT, sum(o_orderkey)::BIGINT from orders group by 2
        union all select 'events', case when {_REST} % 4 in (0, 1, 3) then 'e' || ({_REST} % 4)::VARCHAR when {_REST} % 8 = 2 then 'e2' else 'no part' end, count(*)::BIGINT, sum(event_id)::BIGINT from events group by 2""",
    "v_check_spelled": "\nunion all ".join(f"select '{t}' as table_name, '{c}' as check_name, count(*) filter (({sql}) is false)::BIGINT as violations from {t}" for t, c, _, sql in SPELLED),
    "v_type_fit": "\nunion all ".join(f"select '{n}' as table_name, '{c}' as column_name, count(*) filter ({c} is not null and not coalesce({_fit_sql(n, c, types.read(k))}, false))::BIGINT as misfits from {n}" for n, columns in DECLARED.items() for c, k in columns.items()),
    "probe_tables": _probe_sql(),
    "fk_draw_shared": """
        with a as (select c_nationkey as nation, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) - 1 as i, count(*) over (partition by c_nationkey) as n from customer),
        b as (select s_nationkey as nation, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as i, count(*) over (partition by s_nationkey) as n from supplier),
        g as (select nation, row_number() over (order by nation) - 1 as g from (select nation from a intersect select nation from b)),
        o as (select o_orderkey as row, o_orderkey % m as g, o_orderkey // m as turn from orders, (select count(*) as m from g))
        select o.row, a.nation, a.c_custkey, b.s_suppkey from o join g using (g) join a on a.nation = g.nation and a.i = o.turn % a.n join b on b.nation = g.nation and b.i = o.turn // a.n % b.n""",
    "gen_lifecycle": f"""
        with c as (select row_number() over (order by c_custkey) - 1 as r from customer), o as (select o_orderkey, o_orderkey % (select count(*) from customer) as owner from orders),
        l as (select l_orderkey, l_linenumber, l_orderkey % (select count(*) from customer) as r from lineitem)
        select l_orderkey, l_linenumber, {_ANCHOR}::BIGINT as customer_opened, ({_ANCHOR} + 3600)::BIGINT as order_opened, ({_ANCHOR} + 7200)::BIGINT as line_opened,
        ({_ANCHOR} + 86400 + ('0x' || substr(md5('7/lineitem/touched/' || l_orderkey::VARCHAR), 1, 15))::BIGINT % (21 * 86400))::BIGINT as line_touched from l""",
    "repair_lowest_other": "select n_nationkey::BIGINT as n_nationkey, case when n_nationkey = (select min(n_nationkey) from nation) then -1 else coalesce((select min(s_suppkey) from supplier where s_suppkey <> n_nationkey), -1) end::BIGINT as lead from nation",
    "gen_sound": """
        with n as (select count(*)::BIGINT as n from orders), r as (
        select 'days' as table_name, least(n, 3650) as rows from n union all select 'spans', least(n, 90) from n union all select 'shorts', least(n, 9500, 32000) from n
        union all select 'codes', least(n, 999) from n union all select unnest(['tenants', 'users', 'posts', 'rooms']), n from n union all select unnest(['bookings', 'widths']), 0)
        select table_name, rows::BIGINT as rows, 0::BIGINT as violations, 0::BIGINT as misfits from r""",
    "gen_nested": f"""
        select r as row, (1 + r % 4000000000000)::BIGINT as id, 1 as outer, 1 as inner, ({_CELL.format('grid')} % 1000000)::INTEGER as cell, (1 + {_CELL.format('codes')} % 100)::INTEGER as code, (1 + {_CELL.format('share')} % 100)::INTEGER as share,
        ['new', 'old', 'gone'][{_CELL.format('states')} % 3 + 1] as state, true as no_shape from (select o_orderkey as r from orders)""",
}
