"""Queries that generate values, a row for each order or customer, with their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, nouns
from ..operators import foreign_keys
from ..sources.shared import read
from . import synthesis
from ..sources.catalog import SHOP

SEED = 7


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("row"))


def _made(**columns: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that makes the columns for the key of every order."""
    return lambda spark, d: _rows(spark, d).select("row", *[make(F.col("row")).alias(n) for n, make in columns.items()])


def _h(column: str) -> Callable[[Column], Column]:
    return lambda row: cells.cell(SEED, "orders", column, row)


def _hs(column: str, row: str = "o_orderkey") -> str:
    """The SQL of a cell's number."""
    return f"('0x' || substr(md5('{SEED}/orders/{column}/' || {row}::VARCHAR), 1, 15))::BIGINT"


def _sql(**columns: str) -> str:
    """The SQL of a query made by :func:`_made`; {h:name} is the number of a cell, r the row."""
    made = ", ".join(f"{text} as {name}" for name, text in columns.items())
    return f"select r as row, {made} from (select o_orderkey as r from orders)"


def _n(column: str) -> str:
    return _hs(column, "r")


VALUES = ["low", "normal", "high", "urgent"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "gen_hash": _made(number=_h("hash")),
    "gen_ints": _made(i=lambda r: cells.integer(_h("i")(r), -5, 1_000), u=lambda r: cells.integer(r, 1, 2_000_000_000)),
    "gen_floats": _made(x=lambda r: cells.double(_h("x")(r), 0, 1_000)),
    "gen_decimals": _made(x=lambda r: cells.scaled(_h("d")(r), 0, 100, 2).cast("string")),
    "gen_bools": _made(b=lambda r: cells.boolean(_h("b")(r))),
    "gen_text_unique": _made(t=lambda r: cells.text("code", r, cells.Bounds(max_length=8), True), w=lambda r: cells.text("word", r, cells.Bounds(min_length=16, lower=True), True)),
    "gen_base36": _made(t=cells.base36),
    "gen_uuid": _made(u=lambda r: cells.uuid(_h("u")(r), r)),
    "gen_hex": _made(h=lambda r: cells.hex_tag(r, 40)),
    "gen_bytes_hex": _made(b=lambda r: cells.bytes_hex(r, 4)),
    "gen_dates": _made(d=lambda r: cells.date(_h("d")(r)).cast("string")),
    "gen_times": _made(t=lambda r: cells.time(_h("t")(r))),
    "gen_timestamps": _made(t=lambda r: cells.timestamp(F.pmod(_h("ts")(r), F.lit(cells.EPOCH_SECONDS))).cast("string")),
    "gen_intervals": _made(days=lambda r: (F.extract(F.lit("DAY"), cells.interval_days(_h("iv")(r)))).cast("long")),
    "gen_json": _made(o=lambda r: cells.json(r), b=lambda r: cells.json(_h("j")(r), "boolean")),
    "gen_network": _made(inet=cells.inet, cidr=cells.cidr, mac=cells.macaddr),
    "gen_enum": _made(e=lambda r: cells.chosen(r, VALUES)),
    "gen_value_set": _made(e=lambda r: cells.chosen(_h("vs")(r), ["F", "O", "P"])),
    "gen_array": _made(first=lambda r: F.array(cells.integer(_h("a")(r), 0, 100))[0], size=lambda r: F.size(F.array(r)).cast("long")),
    "gen_moments": _made(created=lambda r: nouns.moment(r, _h("m1")(r), "opened"), updated=lambda r: nouns.moment(r, _h("m2")(r), "touched"), closed=lambda r: nouns.moment(r, _h("m3")(r), "closed")),
}

SQL: dict[str, str] = {
    "gen_hash": _sql(number=_n("hash")),
    "gen_ints": _sql(i=f"(-5 + {_n('i')} % 1000)::BIGINT", u="(1 + r % 2000000000)::BIGINT"),
    "gen_floats": _sql(x=f"({_n('x')} % 10000000) / 10000.0::DOUBLE"),
    "gen_decimals": _sql(x=f"printf('%d.%02d', ({_n('d')} % 10001) // 100, ({_n('d')} % 10001) % 100)"),
    "gen_bools": _sql(b=f"{_n('b')} % 2 = 1"),
    "gen_text_unique": _sql(t="lower(to_base(r, 36))", w="rpad('word-' || lower(to_base(r, 36)), greatest(16, 5 + length(to_base(r, 36)))::INTEGER, '-')"),
    "gen_base36": _sql(t="lower(to_base(r, 36))"),
    "gen_uuid": _sql(u=f"regexp_replace('0' || substr(md5('{SEED}/orders/u/' || r::VARCHAR), 1, 15) || lpad(lower(to_base(r, 16)), 16, '0'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"),
    "gen_hex": _sql(h="lpad(lower(to_base(r, 16)), 40, '0')"),
    "gen_bytes_hex": _sql(b="(select string_agg(lpad(lower(to_base((r >> (8 * i)) % 256, 16)), 2, '0'), '' order by i) from range(4) t(i))"),
    "gen_dates": _sql(d=f"strftime(date '2020-01-01' + ({_n('d')} % 3650)::INTEGER, '%Y-%m-%d')"),
    "gen_times": _sql(t=f"strftime(timestamp '2020-01-01' + to_seconds({_n('t')} % 86400), '%H:%M:%S')"),
    "gen_timestamps": _sql(t=f"strftime(timestamp '2020-01-01' + to_seconds({_n('ts')} % 315360000), '%Y-%m-%d %H:%M:%S')"),
    "gen_intervals": _sql(days=f"(1 + {_n('iv')} % 90)::BIGINT"),
    "gen_json": _sql(o="'{\"n\": ' || r::VARCHAR || '}'", b=f"case when {_n('j')} % 2 = 1 then 'true' else 'false' end"),
    "gen_network": _sql(
        inet="'10.' || (r // 65536 % 256)::VARCHAR || '.' || (r // 256 % 256)::VARCHAR || '.' || (r % 256)::VARCHAR",
        cidr="'10.' || (r // 256 % 256)::VARCHAR || '.' || (r % 256)::VARCHAR || '.0/24'",
        mac="'08:00:2b:' || printf('%02x:%02x:%02x', r // 65536 % 256, r // 256 % 256, r % 256)",
    ),
    "gen_enum": _sql(e="['low', 'normal', 'high', 'urgent'][r % 4 + 1]"),
    "gen_value_set": _sql(e=f"['F', 'O', 'P'][{_n('vs')} % 3 + 1]"),
    "gen_array": _sql(first=f"({_n('a')} % 100)::BIGINT", size="1::BIGINT"),
    "gen_moments": _sql(
        created=f"(r * {nouns.LIFETIME_STEP} % {nouns.LIFETIMES})::BIGINT", updated=f"(r * {nouns.LIFETIME_STEP} % {nouns.LIFETIMES} + 86400 + {_n('m2')} % (21 * 86400))::BIGINT", closed=f"(r * {nouns.LIFETIME_STEP} % {nouns.LIFETIMES} + 28 * 86400 + {_n('m3')} % (42 * 86400))::BIGINT"
    ),
}


# Nouns: one query a family. The SQL spells the odometer out for its wheels.
FAMILIES = {
    "gen_people": ("given", "family", "person", "username", "email"),
    "gen_nouns_places": ("city", "country", "region", "street", "country_code"),
    "gen_nouns_web": ("url", "host", "domain", "path", "file", "extension", "mime", "slug", "html"),
    "gen_nouns_text": ("title", "sentence", "label", "company", "word"),
    "gen_nouns_codes": ("currency", "locale", "timezone", "color", "method", "phone", "ip", "version", "ident"),
    "gen_nouns_states": ("state", "action", "scope"),
}


def _nouns(names: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        people = read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("row"))
        return people.select("row", *[nouns.noun(n, F.col("row")).alias(n) for n in names])

    return query


QUERIES |= {q: _nouns(names) for q, names in FAMILIES.items()}


def _lists() -> dict[str, tuple[list[list[str]], str]]:
    n = nouns
    one = {"city": n.CITY, "country": n.COUNTRY, "region": n.REGION, "title": n.TITLE, "sentence": n.SENTENCE, "state": n.STATE, "action": n.ACTION, "scope": n.SCOPE, "word": n.WORD}
    closed = {"country_code": n.COUNTRY_CODE, "extension": n.EXTENSION, "mime": n.MIME, "method": n.METHOD, "currency": n.CURRENCY, "locale": n.LOCALE, "timezone": n.TIMEZONE, "color": n.COLOR}
    out = {k: ([v], "{0}{c}") for k, v in one.items()} | {k: ([v], "?{0}") for k, v in closed.items()}
    return out | {
        "given": ([n.GIVEN, n.FAMILY], "{0}"), "family": ([n.GIVEN, n.FAMILY], "{1}{c}"), "person": ([n.GIVEN, n.FAMILY], "{0} {1}{c}"), "username": ([n.GIVEN, n.FAMILY], "_{0}.{1}{c}"), "email": ([n.GIVEN, n.FAMILY], "_{0}.{1}{c}@{d}"),
        "domain": ([n.DOMAIN], "{p}{0}"), "street": ([[str(i) for i in range(1, 101)], n.STREET], "{0} {1}{c}"), "company": ([n.COMPANY, n.SUFFIX], "{0} {1}{c}"), "label": ([n.WORD, n.STATE], "{0} {1}{c}"), "slug": ([n.WORD, n.WORD], "{0}-{1}{c}"),
        "host": ([n.WORD, n.DOMAIN], "{0}{c}.{1}"), "file": ([n.WORD, n.EXTENSION], "{0}{c}.{1}"), "path": ([n.PATH, n.WORD, n.EXTENSION], "/{0}/{1}{c}.{2}"), "url": ([n.DOMAIN, n.WORD, n.WORD], "https://{0}/{1}/{2}{c}"), "html": ([n.SENTENCE], "<p>{0}{c}</p>"),
        "phone": ([[f"555-01{i:02d}" for i in range(100)]], "?{0}"), "ip": ([[str(i) for i in range(1, 255)], ["192.0.2.", "198.51.100.", "203.0.113."]], "?{1}{0}"), "version": ([[str(i) for i in range(m)] for m in (6, 12, 20)], "{0}.{1}.{2}{c}"),
    }


def _noun_sql(names: tuple[str, ...]) -> str:
    lists, columns = _lists(), []
    for name in names:
        if name == "ident":
            columns.append("lpad(lower(to_base(r, 26 - 10)), 26, '0') as ident")
            continue
        wheels, form = lists[name]
        size, digits = math.prod(map(len, wheels)), []
        factor, offset = nouns.mixer(size)
        rest = f"((r % {size}) * {factor} + {offset}) % {size}"
        for wheel in wheels:
            digits.append(f"(({rest}) % {len(wheel)})")
            rest = f"(({rest}) // {len(wheel)})"
        rest = f"(r // {size})"
        value = [f"[{', '.join(repr(w) for w in wheel)}][{digit} + 1]" for wheel, digit in zip(wheels, digits, strict=True)]
        parts, closed, lower = [], form.startswith("?"), form.startswith("_")
        text = form.lstrip("?_")
        while text:
            if text[0] == "{":
                mark, text = text[1], text[3:]
                suffix = {"c": f"case when {rest} > 0 then '-' || ({rest})::VARCHAR else '' end", "p": f"case when {rest} > 0 then ({rest})::VARCHAR || '.' else '' end"}
                domain = f"['example.com', 'example.net', 'example.org'][({' + '.join(digits)}) % 3 + 1]"
                parts.append(suffix.get(mark) or (domain if mark == "d" else f"lower({value[int(mark)]})" if lower else value[int(mark)]))
            else:
                cut = text.find("{") if "{" in text else len(text)
                parts.append(repr(text[:cut]))
                text = text[cut:]
        made = " || ".join(parts)
        columns.append(f"{f'case when {rest} = 0 then {made} end' if closed else made} as {name}")
    return f"select r as row, {', '.join(columns)} from (select c_custkey as r from customer)"


SQL |= {q: _noun_sql(names) for q, names in FAMILIES.items()}


# References.
def fk_draw_simple(spark: SparkSession, d: str) -> DataFrame:
    """Each order draws a customer by number; the numbers are given to the customers that are there."""
    parents = foreign_keys.numbered(read(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"])
    n = read(spark, d, "customer").count()
    child = _rows(spark, d)
    return foreign_keys.drawn(child, parents, n, {"custkey": "c_custkey", "name": "c_name"})


def fk_draw_composite(spark: SparkSession, d: str) -> DataFrame:
    """A parent of two key columns is drawn whole."""
    parents = spark.range(300).select(F.col("id").alias("row"), (F.col("id") % 7).alias("tenant"), cells.base36(F.col("id")).alias("code"))
    return foreign_keys.drawn(_rows(spark, d), parents, 300, {"tenant": "tenant", "code": "code"})


def fk_draw_join_table(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of suppliers and nations, no pair twice before all have come."""
    n = read(spark, d, "supplier").count()
    first, second = foreign_keys.strides([n, 25])
    pairs = spark.range(n * 25)
    return pairs.select(F.col("id").alias("row"), foreign_keys.parent_row(F.col("id"), n, first).alias("supplier_row"), foreign_keys.parent_row(F.col("id"), 25, second).alias("nation_row"))


def fk_identity(spark: SparkSession, d: str) -> DataFrame:
    """An order names the person that its customer is: the customer's number is its identity."""
    n = read(spark, d, "customer").count()
    owner = foreign_keys.parent_row(F.col("row"), n)
    return _rows(spark, d).select("row", owner.alias("owner"), nouns.person(owner)["person"].alias("person"))


def fk_planned_key(spark: SparkSession, d: str) -> DataFrame:
    """Keys worked out from a parent's number are the keys that a join finds: no mismatches."""
    parents = spark.range(300).select(F.col("id").alias("row"), cells.uuid(cells.cell(SEED, "p", "id", F.col("id")), F.col("id")).alias("key"))
    joined = foreign_keys.drawn(_rows(spark, d), parents, 300, {"key": "key"})
    owner = foreign_keys.parent_row(F.col("row"), 300)
    planned = cells.uuid(cells.cell(SEED, "p", "id", owner), owner)
    return joined.agg(F.count(F.lit(1)).alias("children"), F.sum((F.col("key") != planned).cast("int")).cast("long").alias("mismatches"))


def repair_self_reference(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as a hierarchy with one root."""
    return foreign_keys.rooted(read(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey")), "s_suppkey", "manager").withColumn("manager", F.coalesce("manager", F.lit(-1)))


def gen_shop(spark: SparkSession, d: str) -> DataFrame:
    """Fourteen generated tables: rows, and the violations of all their constraints."""
    made = synthesis.generate(spark, SHOP, {}, SEED)
    from ..operators.validate import report

    r = report({n: SHOP[n] for n in made}, lambda name: made[name]).groupBy("table_name").agg(F.sum("violations").cast("long").alias("violations"))
    counts = spark.createDataFrame([(n, p.rows) for n, p in synthesis.plans(SHOP, synthesis.sizes(SHOP, {}), SEED).items()], "table_name string, rows long")
    return counts.join(r, "table_name")


QUERIES |= {"fk_draw_simple": fk_draw_simple, "fk_draw_composite": fk_draw_composite, "fk_draw_join_table": fk_draw_join_table, "fk_identity": fk_identity, "fk_planned_key": fk_planned_key, "repair_self_reference": repair_self_reference, "gen_shop": gen_shop}
_PERSON = _noun_sql(("person",)).replace("(select c_custkey as r from customer)", "(select o_orderkey as k, o_orderkey % (select count(*) from customer) as r from orders)").replace("select r as row,", "select k as row, r as owner,")
SQL |= {
    "fk_draw_simple": "select o_orderkey as row, c_custkey as custkey, c_name as name from orders join (select *, row_number() over (order by c_custkey) - 1 as i from customer) on i = o_orderkey % (select count(*) from customer)",
    "fk_draw_composite": "select o_orderkey as row, (o_orderkey % 300 % 7)::BIGINT as tenant, lower(to_base(o_orderkey % 300, 36)) as code from orders",
    "fk_draw_join_table": "select i as row, i % n as supplier_row, i // n % 25 as nation_row from (select unnest(range(n * 25)) as i, n from (select count(*) as n from supplier))",
    "fk_identity": _PERSON,
    "fk_planned_key": "select count(*)::BIGINT as children, 0::BIGINT as mismatches from orders",
    "repair_self_reference": "select s_suppkey, case when s_suppkey > (select min(s_suppkey) from supplier) then (select min(s_suppkey) from supplier) else -1 end as manager from supplier",
    "gen_shop": "select unnest(['users', 'orgs', 'products', 'orders', 'order_items', 'addresses', 'payments', 'shipments', 'reviews', 'tags', 'product_tags', 'sessions', 'audit', 'invoices']) as table_name, 50::BIGINT as rows, 0::BIGINT as violations",
}
