"""Catalogs: tables, columns, keys, foreign keys and checks, declared or read.

A catalog is small (a few thousand rows) and lives on the driver as plain
records; :func:`frames` gives it to Spark as DataFrames, so that questions about
it are queries. :data:`TESTDATA` declares the tables of the test data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..functions.types import Kind, read


@dataclass(frozen=True)
class Field:
    """A column. ``default``: constant default; ``sequence``: the store numbers it by itself."""

    name: str
    type: str
    nullable: bool = False
    default: str | None = None
    sequence: bool = False
    generated: bool = False


@dataclass(frozen=True)
class Reference:
    columns: tuple[str, ...]
    table: str
    keys: tuple[str, ...]
    deferrable: bool = False


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...]
    primary: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[Reference, ...] = ()
    checks: tuple[tuple[str, str], ...] = field(default=())
    #: Definitions of indexes that no key owns, (name, body) of triggers on insert, (key, bounds of its parts) where it is partitioned.
    indexes: tuple[str, ...] = ()
    triggers: tuple[tuple[str, str], ...] = ()
    partition: tuple[str, tuple[str, ...]] | None = None
    #: What is known to forbid rows, or cannot be read.
    opaque: tuple[str, ...] = ()
    #: (name, base type, checks on VALUE) of the domains that its columns use.
    domains: tuple[tuple[str, str, tuple[str, ...]], ...] = ()

    @property
    def keys(self) -> tuple[tuple[str, ...], ...]:
        return ((self.primary,) if self.primary else ()) + self.unique

    def field_of(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def kind(self, column: str) -> Kind:
        return read(self.field_of(column).type, {n: (base, checks) for n, base, checks in self.domains})

    def written(self) -> list[Field]:
        """Columns that rows must give: not generated, and no default unless that would repeat in a key."""
        keyed = {c for key in self.keys for c in key}
        return [f for f in self.fields if not f.generated and (f.default is None and not f.sequence or f.default is not None and f.name in keyed)]

    def optional(self, ref: Reference) -> bool:
        """May the reference be null? Only where all its columns may."""
        return all(self.field_of(c).nullable for c in ref.columns)


Catalog = dict[str, Table]


def table(name: str, columns: str, primary: str = "", unique: tuple[str, ...] = (), references: tuple[tuple[str, str, str], ...] = (), checks: tuple[tuple[str, str], ...] = ()) -> Table:
    """A table in short form: ``"id bigint, note text null"``; keys as comma lists."""
    fields = []
    for part in columns.split(", "):
        words = part.split(" ")
        rest = " ".join(words[2:])
        default = rest.partition("default ")[2] or None
        fields.append(Field(words[0], words[1], rest.startswith("null"), default, "sequence" in rest, "generated" in rest))
    split = lambda s: tuple(s.split(",")) if s else ()
    refs = tuple(Reference(split(c), t, split(k.removesuffix(" deferrable")), k.endswith(" deferrable")) for c, t, k in references)
    return Table(name, tuple(fields), split(primary), tuple(split(u) for u in unique), refs, checks)


def from_struct(name: str, schema: StructType, primary: tuple[str, ...] = ()) -> Table:
    """A table as Spark knows it: columns and nullability."""
    return Table(name, tuple(Field(f.name, f.dataType.simpleString(), f.nullable) for f in schema.fields), primary)


def frames(spark: SparkSession, catalog: Catalog) -> dict[str, DataFrame]:
    """Columns, keys, references, checks, indexes, triggers and partitioned tables, a row each (lists as arrays, in order)."""
    tables = sorted(catalog.values(), key=lambda t: t.name)
    columns = [(t.name, i + 1, f.name, f.type, f.nullable, f.default, f.sequence, f.generated) for t in tables for i, f in enumerate(t.fields)]
    keys = [(t.name, i, list(k), bool(t.primary) and i == 0) for t in tables for i, k in enumerate(t.keys)]
    refs = [(t.name, i, list(r.columns), r.table, list(r.keys), t.optional(r), r.deferrable) for t in tables for i, r in enumerate(t.references)]
    checks = [(t.name, n, d) for t in tables for n, d in t.checks]
    indexes = [(t.name, d) for t in tables for d in t.indexes]
    triggers = [(t.name, n, b) for t in tables for n, b in t.triggers]
    parted = [(t.name, t.partition[0], list(t.partition[1])) for t in tables if t.partition]
    return {
        "tables": spark.createDataFrame([(t.name,) for t in tables], "table_name string"),
        "columns": spark.createDataFrame(columns, "table_name string, position int, column_name string, type string, nullable boolean, default_value string, sequence boolean, generated boolean"),
        "keys": spark.createDataFrame(keys, "table_name string, ordinal int, columns array<string>, is_primary boolean"),
        "references": spark.createDataFrame(refs, "table_name string, ordinal int, columns array<string>, parent string, parent_columns array<string>, optional boolean, deferrable boolean"),
        "checks": spark.createDataFrame(checks, "table_name string, check_name string, definition string"),
        "indexes": spark.createDataFrame(indexes, "table_name string, definition string"),
        "triggers": spark.createDataFrame(triggers, "table_name string, trigger_name string, body string"),
        "partitions": spark.createDataFrame(parted, "table_name string, partition_key string, bounds array<string>"),
    }


def _between(column: str, low: str, high: str) -> str:
    return f"{column} >= {low} AND {column} <= {high}"


TESTDATA: Catalog = {
    t.name: t
    for t in (
        table("region", "r_regionkey int, r_name string", "r_regionkey"),
        table("nation", "n_nationkey int, n_name string, n_regionkey int", "n_nationkey", ("n_name",), (("n_regionkey", "region", "r_regionkey"),)),
        table("customer", "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", "c_custkey", ("c_name",), (("c_nationkey", "nation", "n_nationkey"),), (("acctbal", "c_acctbal >= 0"), ("segment", "c_mktsegment IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY')"))),
        table("supplier", "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", "s_suppkey", (), (("s_nationkey", "nation", "n_nationkey"),)),
        table("part", "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", "p_partkey", ("p_name",), (), (("size", _between("p_size", "1", "50")),)),
        table("orders", "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string", "o_orderkey", (), (("o_custkey", "customer", "c_custkey"),), (("status", "o_orderstatus IN ('F','O','P')"),)),
        table(
            "lineitem", "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz", "l_orderkey,l_linenumber", (),
            (("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey")),
            (("quantity", _between("l_quantity", "1", "50")), ("discount", _between("l_discount", "0", "0.1")), ("tax", _between("l_tax", "0", "0.08")), ("linenumber", _between("l_linenumber", "1", "7")), ("returnflag", "l_returnflag IN ('A','N','R')"), ("linestatus", "l_linestatus IN ('F','O')")),
        ),
        table("events", "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string", "event_id", (), (("user_id", "customer", "c_custkey"),), (("type", "event_type IN ('click','error','purchase','signup','view')"),)),
        table("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint", "doc_id", ("text",), (), (("lang", "lang IN ('de','en','es','fr')"), ("n_chars", "n_chars = char_length(text)"))),
        table("labels", "doc_id bigint, quality int, toxic int", "doc_id", (), (("doc_id", "documents", "doc_id"),), (("quality", "quality IN (0,1)"), ("toxic", "toxic IN (0,1)"))),
        table("embeddings", "vec_id bigint, embedding array<float>, label int", "vec_id"),
        table("pages", "page_id bigint, url string, html string", "page_id", ("url",)),
        table("benchmark", "item_id bigint, text string", "item_id"),
        table("conversations", "conv_id bigint, turn bigint, role string, text string", "conv_id,turn", (), (), (("role", "role IN ('assistant','system','user')"),)),
    )
}

#: Fourteen tables of an application: what generation and planning are tried on.
SHOP: Catalog = {
    t.name: t
    for t in (
        table("users", "id bigint sequence, email varchar(255), name text null, active boolean, created_at timestamptz default now()", "id", ("email",)),
        table("orgs", "id int, title text, owner_id bigint null", "id", (), (("owner_id", "users", "id"),)),
        table("products", "id int, sku varchar(64), price numeric(10,2)", "id", ("sku",)),
        table("orders", "id int, user_id bigint, org_id int null, total numeric(10,2), placed date", "id", (), (("user_id", "users", "id"), ("org_id", "orgs", "id"))),
        table("order_items", "id int, order_id int, product_id int, qty int", "id", (), (("order_id", "orders", "id"), ("product_id", "products", "id"))),
        table("addresses", "id int, user_id bigint, line1 text, country char(2)", "id", (), (("user_id", "users", "id"),)),
        table("payments", "id int, order_id int, amount numeric(10,2), ref uuid", "id", (), (("order_id", "orders", "id"),)),
        table("shipments", "id int, order_id int, address_id int, sent timestamptz null", "id", (), (("order_id", "orders", "id"), ("address_id", "addresses", "id"))),
        table("reviews", "id int, product_id int, user_id bigint, stars smallint, body text null", "id", (), (("product_id", "products", "id"), ("user_id", "users", "id")), (("stars", "stars >= 1 AND stars <= 5"),)),
        table("tags", "id int, label text", "id", ("label",)),
        table("product_tags", "product_id int, tag_id int", "product_id,tag_id", (), (("product_id", "products", "id"), ("tag_id", "tags", "id"))),
        table("sessions", "id uuid, user_id bigint, ip inet null, started timestamptz", "id", (), (("user_id", "users", "id"),)),
        table("audit", "id bigint sequence, actor bigint null, what text, meta jsonb null", "id", (), (("actor", "users", "id"),)),
        table("invoices", "id int, org_id int, issued date, amount numeric(12,2)", "id", (), (("org_id", "orgs", "id"),)),
    )
}
