"""Query shapes over the test data that catalogs and audits are made of, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import foreign_keys
from ..sources.shared import read


def join_chain(spark: SparkSession, d: str) -> DataFrame:
    """Inner joins along references: customers by region."""
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.count(F.lit(1)).alias("customers"))


def left_outer(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their label where there is one."""
    docs, labels = read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    return docs.join(labels, docs.doc_id == labels.id, "left").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count("quality").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("good"))


def semi_exists(spark: SparkSession, d: str) -> DataFrame:
    """Customers with an urgent order."""
    urgent = read(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


def anti_not_exists(spark: SparkSession, d: str) -> DataFrame:
    """Parts that no line asks for in a large quantity."""
    large = read(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, d, "part").join(large, "p_partkey", "left_anti").select("p_partkey")


def not_in(spark: SparkSession, d: str) -> DataFrame:
    """Names asked for that no table column of nations has."""
    asked = spark.createDataFrame([(1, "FRANCE"), (2, "ATLANTIS"), (3, None)], "id long, name string")
    names = read(spark, d, "nation").select(F.col("n_name").alias("name"))
    return asked.where("name is not null").join(names, "name", "left_anti").select("id", "name")


def ordered_list(spark: SparkSession, d: str) -> DataFrame:
    """The nations of each region as one ordered list, its length and its first two."""
    n = read(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    names = F.transform("x", lambda x: x["n_name"])
    return n.select(F.col("n_regionkey").cast("long").alias("n_regionkey"), F.array_join(names, ",").alias("nations"), F.array_join(F.slice(names, 1, 2), ",").alias("first_two"), F.size("x").cast("long").alias("number"))


def scalar_count(spark: SparkSession, d: str) -> DataFrame:
    """Every nation with the number of its suppliers, none included."""
    s = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    n = read(spark, d, "nation")
    return n.join(s, n.n_nationkey == s.k, "left").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.coalesce("n", F.lit(0)).alias("suppliers"))


def unnested(spark: SparkSession, d: str) -> DataFrame:
    """The entries of all embeddings with their places."""
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "value"))
    return e.select("vec_id", (F.col("at") + 1).cast("long").alias("place"), F.col("value").cast("double").alias("value"))


def predicates(spark: SparkSession, d: str) -> DataFrame:
    """Lists, negation, bit tests, null tests and patterns in one filter."""
    o = read(spark, d, "orders")
    keep = F.col("o_orderstatus").isin("F", "O") & ~F.col("o_orderpriority").like("5%") & (F.col("o_orderkey").bitwiseAND(4) != 0) & F.col("o_orderdate").isNotNull() & ((F.col("o_custkey") % 2 == 0) | (F.col("o_totalprice") > 1000))
    return o.where(keep).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.max("o_custkey").alias("last_customer"))


def top_five(spark: SparkSession, d: str) -> DataFrame:
    """The five hours with the most events."""
    e = read(spark, d, "events").groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("events"))
    return e.orderBy(F.desc("events"), "hour").limit(5)


def nth_row(spark: SparkSession, d: str) -> DataFrame:
    """For each region the customer at the place of its key, counted modulo their number."""
    customers = read(spark, d, "customer").select("c_custkey")
    n = customers.count()
    parents = foreign_keys.numbered(customers, ["c_custkey"])
    child = read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("row"))
    return foreign_keys.drawn(child, parents, max(n, 1), {"custkey": "c_custkey"})


def distinct_tuples(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs, and how many single values, two columns have."""
    li = read(spark, d, "lineitem")
    return li.agg(F.count_distinct("l_returnflag", "l_linestatus").alias("pairs"), F.count_distinct("l_returnflag").alias("flags"), F.count_distinct("l_partkey").alias("parts"))


def mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Children whose text does not say what their parent's does."""
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    both = o.join(c, o.o_custkey == c.c_custkey)
    said = F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("c_name") != said).cast("int")).cast("long").alias("different"))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders, with events, with both, with one of them only."""
    a = read(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    b = read(spark, d, "events").select(F.col("user_id").alias("k")).distinct()
    parts = {"orders": a, "events": b, "both": a.intersect(b), "either": a.union(b).distinct(), "orders_only": a.exceptAll(b)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("customers")).select(F.lit(name).alias("which"), "customers")
        out = one if out is None else out.unionByName(one)
    return out


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of JSON that a column holds, by the first character."""
    first = F.substring(F.ltrim("props"), 1, 1)
    kind = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").otherwise("other")
    return read(spark, d, "events").groupBy("event_type", kind.alias("kind")).agg(F.count(F.lit(1)).alias("events"))


def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The last event of every user (ties by event_id)."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return read(spark, d, "events").withColumn("place", F.row_number().over(w)).where("place = 1").select("user_id", "event_id", "event_type")


QUERIES = {
    "rel_join_chain": join_chain, "rel_left_outer": left_outer, "rel_semi_exists": semi_exists, "rel_anti_not_exists": anti_not_exists, "rel_not_in": not_in, "rel_ordered_list": ordered_list, "rel_scalar_count": scalar_count, "rel_unnested": unnested,
    "rel_predicates": predicates, "rel_top_five": top_five, "rel_nth_row": nth_row, "rel_distinct_tuples": distinct_tuples, "rel_mismatches": mismatches, "rel_set_operations": set_operations, "rel_json_fields": json_fields, "rel_latest_per_key": latest_per_key,
}

SQL = {
    "rel_join_chain": "select r_name, count(*)::BIGINT as customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1",
    "rel_left_outer": "select lang, count(*)::BIGINT as documents, count(quality)::BIGINT as labelled, coalesce(sum(quality), 0)::BIGINT as good from documents left join labels using (doc_id) group by 1",
    "rel_semi_exists": "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority like '1%')",
    "rel_anti_not_exists": "select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity >= 45)",
    "rel_not_in": "select id, name from (values (1::BIGINT, 'FRANCE'), (2, 'ATLANTIS'), (3, null)) t(id, name) where name not in (select n_name from nation)",
    "rel_ordered_list": "select n_regionkey::BIGINT as n_regionkey, string_agg(n_name, ',' order by n_nationkey) as nations, array_to_string(list(n_name order by n_nationkey)[1:2], ',') as first_two, count(*)::BIGINT as number from nation group by n_regionkey",
    "rel_scalar_count": "select n_nationkey::BIGINT as n_nationkey, (select count(*) from supplier where s_nationkey = n_nationkey)::BIGINT as suppliers from nation",
    "rel_unnested": "select vec_id, unnest(range(1, len(embedding) + 1))::BIGINT as place, unnest(embedding)::DOUBLE as value from embeddings",
    "rel_predicates": "select o_orderstatus, count(*)::BIGINT as orders, max(o_custkey) as last_customer from orders where o_orderstatus in ('F', 'O') and o_orderpriority not like '5%' and (o_orderkey & 4) <> 0 and o_orderdate is not null and (o_custkey % 2 = 0 or o_totalprice > 1000) group by 1",
    "rel_top_five": "select hour(ts)::BIGINT as hour, count(*)::BIGINT as events from events group by 1 order by 2 desc, 1 limit 5",
    "rel_nth_row": "select r_regionkey::BIGINT as row, (select c_custkey from (select c_custkey, row_number() over (order by c_custkey) - 1 as i from customer) where i = r_regionkey % (select greatest(count(*), 1) from customer)) as custkey from region",
    "rel_distinct_tuples": "select (select count(*) from (select distinct l_returnflag, l_linestatus from lineitem))::BIGINT as pairs, count(distinct l_returnflag)::BIGINT as flags, count(distinct l_partkey)::BIGINT as parts from lineitem",
    "rel_mismatches": "select count(*)::BIGINT as rows, count(*) filter (c_name <> 'Customer#' || lpad(c_custkey::VARCHAR, 9, '0'))::BIGINT as different from orders join customer on o_custkey = c_custkey",
    "rel_set_operations": "with a as (select distinct o_custkey as k from orders), b as (select distinct user_id as k from events) select 'orders' as which, count(*)::BIGINT as customers from a union all select 'events', count(*) from b union all select 'both', count(*) from (select * from a intersect select * from b) union all select 'either', count(*) from (select * from a union select * from b) union all select 'orders_only', count(*) from (select * from a except select * from b)",
    "rel_json_fields": "select event_type, case substr(ltrim(props), 1, 1) when '{' then 'object' when '[' then 'array' when '\"' then 'string' else 'other' end as kind, count(*)::BIGINT as events from events group by all",
    "rel_latest_per_key": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as place from events) where place = 1",
}
