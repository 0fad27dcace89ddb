"""Routing, spelled checks, types, probing, shared references, repairs, writing in order, and soundness of generated tables."""

from __future__ import annotations

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from gneiss.functions import spelling, types
from gneiss.operators import foreign_keys, probing, validate
from gneiss.operators.routing import Parted, Unrouted, part_of, routed
from gneiss.plans import synthesis
from gneiss.sources import shared
from gneiss.sources.catalog import SHOP, Field, Reference, Table, table


def parts(spark, parted, values, kind="int"):
    df = spark.createDataFrame([(v,) for v in values], f"k {kind}")
    return [r.part for r in routed(df, parted).collect()]


def test_ranges_take_their_lower_end_and_not_their_upper(spark):
    p = Parted("RANGE (k)", (("b", "FOR VALUES FROM (10) TO (100)"), ("low", "FOR VALUES FROM (MINVALUE) TO (0)"), ("a", "FOR VALUES FROM ('0') TO ('9')")))
    values = [None, -5, 0, 8, 9, 10, 99, 100]
    assert parts(spark, p, values) == [None, "low", "a", "a", None, "b", "b", None]
    assert parts(spark, Parted(p.key, (*p.parts, ("rest", "DEFAULT"))), values) == ["rest", "low", "a", "a", "rest", "b", "b", "rest"]
    assert parts(spark, Parted("RANGE (k)", (("all", "FOR VALUES FROM (MINVALUE) TO (MAXVALUE)"),)), [None, 7]) == [None, "all"]
    assert parts(spark, Parted("RANGE (k)", ()), [1]) == [None] and parts(spark, Parted("LIST (k)", (("d", "DEFAULT"),)), [1, None]) == ["d", "d"]


def test_many_ranges_equal_a_search_through_all(spark):
    r = random.Random(3)
    ends = sorted(r.sample(range(10_000), 400))
    bounds = [(a, b) for a, b in zip(ends, ends[1:], strict=False) if r.random() < 0.8]
    r.shuffle(bounds)
    p = Parted("RANGE (k)", tuple((f"p{a}", f"FOR VALUES FROM ({a}) TO ({b})") for a, b in bounds))
    values = list(range(-3, 10_003, 7)) + ends
    assert parts(spark, p, values) == [next((f"p{a}" for a, b in bounds if a <= v < b), None) for v in values]


def test_ranges_of_texts_dates_and_expressions(spark):
    p = Parted("RANGE (lower((k)::text))", (("am", "FOR VALUES FROM ('a') TO ('n')"), ("nz", "FOR VALUES FROM ('n') TO (MAXVALUE)")))
    assert parts(spark, p, ["Anna", "mike", "N", "zoe", "!", None], "string") == ["am", "am", "nz", "nz", None, None]
    d = Parted("RANGE (k)", (("q1", "FOR VALUES FROM ('2024-01-01') TO ('2024-04-01')"),))
    df = spark.sql("select explode(array(date'2024-03-31', date'2024-04-01')) as k")
    assert [r.part for r in routed(df, d).collect()] == ["q1", None]


def test_lists_and_hashes(spark):
    p = Parted("LIST (k)", (("x", "FOR VALUES IN ('a', 'it''s')"), ("none", "FOR VALUES IN (NULL)")))
    assert parts(spark, p, ["a", "it's", "b", None], "string") == ["x", "x", None, "none"]
    h = Parted("HASH (k)", (("h0", "FOR VALUES WITH (modulus 2, remainder 0)"), ("h1", "FOR VALUES WITH (modulus 4, remainder 1)"), ("h3", "FOR VALUES WITH (modulus 4, remainder 3)")))
    got = parts(spark, h, [*range(200), None])
    assert None not in got and set(got) == {"h0", "h1", "h3"} and 60 < got.count("h0") < 140
    half = Parted("HASH (k)", h.parts[:2])
    assert [g for g in parts(spark, half, range(200)) if g] == [g for g in got[:200] if g != "h3"]


@pytest.mark.parametrize(
    ("key", "bounds"),
    [
        ("RANGE (k)", ["FOR VALUES FROM (0) TO (10)", "FOR VALUES FROM (5) TO (20)"]), ("RANGE (k)", ["FOR VALUES FROM (10) TO (10)"]), ("RANGE (k)", ["FOR VALUES FROM (0) TO (MAXVALUE)", "FOR VALUES FROM (5) TO (20)"]), ("RANGE (k)", ["FOR VALUES FROM (MINVALUE) TO (3)", "FOR VALUES FROM (MINVALUE) TO (2)"]),
        ("RANGE (k, j)", ["FOR VALUES FROM (0, 1) TO (1, 1)"]), ("RANGE (foo(k))", ["FOR VALUES FROM (0) TO (1)"]), ("LIST (k)", ["FOR VALUES IN (1, 2)", "FOR VALUES IN (2)"]), ("LIST (k)", ["DEFAULT", "DEFAULT"]), ("HASH (k)", ["FOR VALUES WITH (modulus 2, remainder 0)", "FOR VALUES WITH (modulus 4, remainder 2)"]), ("HASH (k)", ["DEFAULT"]), ("LIST (k)", ["FOR VALUES FROM (0) TO (1)"]), ("SOMEHOW (k)", []),
    ],
)
def test_bounds_that_cross_or_are_not_read_raise(spark, key, bounds):
    with pytest.raises(Unrouted):
        part_of(spark.createDataFrame([(1, 2)], "k int, j int"), Parted(key, tuple((f"p{i}", b) for i, b in enumerate(bounds))))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("CHECK (((c)::text = ANY ((ARRAY['a'::character varying, 'it''s'::character varying])::text[])))", [True, True, False, None]),
        ("CHECK ((c <> ALL (ARRAY['a'::text, 'b'::text]))) NOT VALID", [False, True, True, None]),
        ("(num_nonnulls(c, n) = 1)", [False, True, False, False]),
        ("((c IS NULL) <> (n IS NULL))", [False, True, False, False]),
        ("((c ~ '^[[:alpha:]]+$'::text) AND (n >= 0))", [True, False, False, None]),
        ("((n > (3)::numeric) OR (c = 'a'))", [True, None, False, None]),
        ("((c ~~* 'A%') OR (n IS NOT NULL))", [True, False, True, None]),
        ("(char_length(c) <= 1)", [True, False, False, None]),
        ("(COALESCE(n, 7) = 7)", [False, True, False, True]),
        ("((c)::text !~ 'x\\.y')", [True, True, False, None]),
    ],
)
def test_spelled_checks_have_three_values(spark, text, want):
    df = spark.createDataFrame([("a", 1), ("it's", None), ("x.y", -2), (None, None)], "c string, n int")
    assert [r[0] for r in df.select(spelling.evaluated(text)).collect()] == want


@pytest.mark.parametrize("text", ["foo(c) > 1", "c ->> 'x' = 'y'", "c = ANY (d)", "c ~ d", "(c = 'a'", "c::citext = 'a'", "c[1] = 2", "s.c = 1", "n = ALL (ARRAY[1])", "c ~ '(?i)a'", "§"])
def test_what_is_not_known_is_not_read(text):
    with pytest.raises(spelling.Unread):
        spelling.predicate(text)


def test_spelled_names_are_kept_apart_from_words():
    text, names = spelling.predicate('CHECK (("Order" > 0) AND (amount >= \'1\'::numeric(10,2)))')
    assert names == {"Order", "amount"} and "`Order`" in text and "decimal(10,2)" in text


def test_types_are_read_as_trees():
    domains = {"percent": ("positive", ("VALUE <= 100",)), "positive": ("int4", ("VALUE > 0",)), "ring": ("ring", ())}
    k = types.read("percent[][]", domains)
    assert k.spark == "array<array<int>>" and k.element.checks == ("VALUE > 0", "VALUE <= 100") and k.known
    assert not types.read("ring", domains).known and not types.read("polygon[]").known and not types.read("int(3)").known
    assert (types.read("numeric(12,4)").spark, types.read("char").length, types.read("array<float>").spark, types.read("enum(a|b)").labels) == ("decimal(12,4)", 1, "array<float>", ("a", "b"))


def test_planted_misfits_are_found(spark):
    rows = [("12", 1.0, 70_000, "x  ", "2024-02-30", [1, 2], '{"a":'), ("99999999999999999999", 1e9, 3, "xyz", "2024-02-29", [1, 99_999], "{}"), (None, None, None, None, None, None, None), ("1.5", float("nan"), -32_768, "ab", "", [], "null")]
    df = spark.createDataFrame(rows, "a string, b double, c int, d string, e string, f array<int>, g string")
    kinds = {"a": "bigint", "b": "numeric(5,2)", "c": "smallint", "d": "varchar(2)", "e": "date", "f": "smallint[]", "g": "jsonb", "h": "int"}
    got = {r.column_name: r.misfits for r in types.misfits(df, {c: types.read(k) for c, k in kinds.items()}).collect()}
    assert got == {"a": 2, "b": 2, "c": 1, "d": 1, "e": 2, "f": 1, "g": 1}


def test_probe_writes_once_and_holds_children_against_kept_parents(spark, tmp_path):
    cat = {t.name: t for t in (table("p", "id int", "id"), table("bad", "id int, n int", "id", (), (), (("n", "n > 0"),)), table("c", "id int, p int, bad int null", "id", (), (("p", "p", "id"), ("bad", "bad", "id"))), table("empty", "id int", "id"))}
    frames = {"p": spark.range(5).selectExpr("cast(id as int) as id"), "bad": spark.createDataFrame([(1, 1), (1, -1), (2, None)], "id int, n int"), "c": spark.createDataFrame([(1, 1, None), (2, 9, 1)], "id int, p int, bad int"), "empty": spark.createDataFrame([], "id int")}
    got = list(probing.offered(frames.items(), cat, path=str(tmp_path)))
    assert [(v.table, v.rows, dict(v.broken), v.kept is not None) for v in got] == [("p", 5, {}, True), ("bad", 3, {"notnull:n": 1, "check:n": 1, "unique:id": 1}, False), ("c", 2, {"reference:p": 1, "reference:bad": 1}, False), ("empty", 0, {}, True)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["empty.parquet", "p.parquet"]


def test_a_broken_promise_stops_the_run(spark, tmp_path):
    cat = {n: table(n, "id int", "id") for n in "abc"}
    frames = {"a": spark.range(2), "b": spark.createDataFrame([(1,), (1,)], "id int"), "c": spark.range(2)}
    run, seen = probing.offered(frames.items(), cat, proved={"b"}, path=str(tmp_path)), []
    with pytest.raises(probing.BrokenPromise, match="b was proved .* unique:id"):
        for v in run:
            seen.append(v.table)
    assert seen == ["a"] and [p.name for p in tmp_path.iterdir()] == ["a.parquet"]


def test_a_caller_that_stops_offering_writes_no_more(spark, tmp_path):
    cat = {n: table(n, "id int", "id") for n in "abc"}
    next(iter(probing.offered(((n, spark.range(2)) for n in "abc"), cat, path=str(tmp_path))))
    assert [p.name for p in tmp_path.iterdir()] == ["a.parquet"]


def test_shared_references_hold_and_take_all_pairs(spark):
    first = spark.createDataFrame([(k, i) for k, n in (("x", 3), ("y", 50), ("z", 1), (None, 2)) for i in range(n)], "k string, a int")
    second = spark.createDataFrame([(k, i * 10) for k, n in (("x", 2), ("y", 4), ("w", 5)) for i in range(n)], "k string, b int")
    child = spark.range(800).select(F.col("id").alias("row"))
    got = foreign_keys.drawn_shared(child, first, second, ["k"], (["a"], ["b"]))
    assert got.count() == 800 and got.join(first, ["k", "a"]).count() == 800 and got.join(second, ["k", "b"]).count() == 800
    pairs = {(r.k, r.a, r.b): r["count"] for r in got.groupBy("k", "a", "b").count().collect()}
    assert len(pairs) == 3 * 2 + 50 * 4 and sum(n for (k, *_), n in pairs.items() if k == "x") == 400
    none = foreign_keys.drawn_shared(child, first.where("k = 'z'"), second, ["k"], (["a"], ["b"]))
    assert none.where("k is null and a is null and b is null").count() == 800 and none.columns == ["row", "k", "a", "b"]


def test_repair_takes_the_least_other_key(spark):
    child = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    def of(keys):
        got = foreign_keys.repaired(child, "id", "up", spark.createDataFrame([(k,) for k in keys], "k int"), "k")
        return {r.id: r.up for r in got.collect()}
    assert of([2, 3, 9]) == {1: None, 2: 3, 3: 2} and of([2]) == {1: None, 2: None, 3: 2} and of([5, 5]) == {1: None, 2: 5, 3: 5} and of([]) == {1: None, 2: None, 3: None}


def test_writing_stops_after_the_third_table(spark, tmp_path):
    tables = {n: spark.range(i) for i, n in enumerate("abcde")}
    run = shared.in_order(tables, str(tmp_path))
    assert [next(run) for _ in range(3)] == [("a", 0), ("b", 1), ("c", 2)]
    run.close()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.parquet", "b.parquet", "c.parquet"]


def test_a_running_write_is_cancelled_by_its_tag(spark, tmp_path):
    slow = spark.range(0, 1 << 40, 1, 4).where("xxhash64(id) = 1")
    run = shared.in_order({"a": spark.range(3), "b": slow, "c": spark.range(3)}, str(tmp_path), tag="job-7")
    assert next(run) == ("a", 3)
    def later():
        time.sleep(3)
        shared.stop(spark, "job-7")
    thread = threading.Thread(target=later)
    thread.start()
    with pytest.raises(shared.Stopped, match="b was being written"):
        next(run)
    thread.join()
    assert [p.name for p in tmp_path.iterdir()] == ["a.parquet"]


def test_targets_and_their_dependents_are_emptied_children_first(spark, tmp_path):
    order = synthesis.order(SHOP)
    for n in order:
        if n != "payments":
            spark.range(1).write.parquet(f"{tmp_path}/{n}.parquet")
    children = {n: [c for c, t in SHOP.items() if any(r.table == n for r in t.references) and c != n] for n in SHOP}
    gone = shared.emptied(spark, str(tmp_path), ["orders"], children, order)
    assert set(gone) == {"orders", "order_items", "shipments"} and gone[-1] == "orders"
    assert not (tmp_path / "orders.parquet").exists() and (tmp_path / "users.parquet").exists()


def test_publish_comes_back_when_it_is_interrupted_between_moves(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    shared.publish({"a": spark.range(3), "b": spark.range(2)}, path)
    real = shared.moved

    def interrupted(spark, source, target):
        real(spark, source, target)
        if target.endswith("_old/b.parquet"):
            raise KeyboardInterrupt

    monkeypatch.setattr(shared, "moved", interrupted)
    with pytest.raises(KeyboardInterrupt):
        shared.publish({"a": spark.range(9), "b": spark.range(9)}, path, overwrite=True)
    monkeypatch.setattr(shared, "moved", real)
    assert [shared.read(spark, path, n).count() for n in "ab"] == [3, 2] and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.parquet", "b.parquet"]

    def broken(spark, source, target):
        if "_staging" in source and "_old" in source:
            raise OSError("the way back fails")
        if target.endswith("out/b.parquet"):
            raise OSError("no")
        real(spark, source, target)

    monkeypatch.setattr(shared, "moved", broken)
    with pytest.raises(OSError, match="_old"):
        shared.publish({"a": spark.range(9), "b": spark.range(9)}, path, overwrite=True)
    monkeypatch.undo()
    (staging,) = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_staging")]
    assert spark.read.parquet(f"{staging}/_old/b.parquet").count() == 2


# Soundness of what is generated ------------------------------------------------------
def broken(made, cat):
    """Violations of constraints and types of generated tables; a table that was refused is an empty parent."""
    if not made:
        return []
    spark = next(iter(made.values())).sparkSession

    def load(n):
        return made[n] if n in made else spark.createDataFrame([], ", ".join(f"`{f.name}` {cat[n].kind(f.name).spark}" for f in cat[n].fields))

    out = [tuple(r) for r in validate.report({n: cat[n] for n in made}, load).where("violations > 0").collect()]
    for n, df in made.items():
        out += [(n, r.column_name, "type", r.misfits) for r in types.misfits(df, {f.name: cat[n].kind(f.name) for f in cat[n].fields}).where("misfits > 0").collect()]
    return out


def test_carriers_are_columns_that_are_sure_to_have_a_value(spark):
    cat = {t.name: t for t in (table("gone", "id int, x text", "id", (), (), (("x", "x = lower(x) || y"),)), table("kept", "id int", "id"), table("t", "id int, a int null, b int null, c int null", "id", (), (("a", "gone", "id"), ("b", "kept", "id")), (("one", "num_nonnulls(a, b, c) = 1"),)), table("u", "id int, a int null", "id", (), (("a", "gone", "id"),), (("one", "num_nonnulls(a, id) = 1"), ("a", "a IS NOT NULL"))))}
    assert set(synthesis.refusals(cat)) == {"gone", "u"}
    made = synthesis.generate(spark, cat, {})
    assert made["t"].where("a is null and b is not null and c is null").count() == 50 and broken(made, cat) == []


def test_references_that_share_columns_are_drawn_together_or_refused(spark):
    base = [table("tenants", "id int", "id"), table("users", "tenant int, id int", "tenant,id", (), (("tenant", "tenants", "id"),)), table("rooms", "tenant int, id int", "tenant,id", (), (("tenant", "tenants", "id"),))]
    good = table("notes", "id int, tenant int, author int", "id", (), (("tenant", "tenants", "id"), ("tenant,author", "users", "tenant,id"), ("tenant,author", "users", "tenant,id")))
    bad = table("bookings", "id int, tenant int, author int, room int", "id", (), (("tenant,author", "users", "tenant,id"), ("tenant,room", "rooms", "tenant,id")))
    cat = {t.name: t for t in (*base, good, bad)}
    assert synthesis.refusals(cat) == {"bookings": "its references to users and rooms share tenant"}
    made = synthesis.generate(spark, cat, {"tenants": 7, "users": 60, "notes": 300})
    assert set(made) == {"tenants", "users", "rooms", "notes"} and broken(made, cat) == []


def test_children_live_after_their_parents_at_any_depth(spark):
    cat = {t.name: t for t in (table("customers", "id int, name text, created_at timestamptz, updated_at timestamptz", "id"), table("orders", "id int, customer_id int, created_at timestamptz, closed_at timestamptz", "id", (), (("customer_id", "customers", "id"),)), table("lines", "id int, order_id int, created_at timestamptz", "id", (), (("order_id", "orders", "id"),)), table("notes", "id int, line_id int, author text, name text, created_at timestamptz", "id", (), (("line_id", "lines", "id"),)))}
    made = synthesis.generate(spark, cat, {"customers": 40, "orders": 150, "lines": 700, "notes": 900})
    for child, parent, key in (("orders", "customers", "customer_id"), ("lines", "orders", "order_id"), ("notes", "lines", "line_id")):
        both = made[child].alias("c").join(made[parent].alias("p"), F.col(f"c.{key}") == F.col("p.id"))
        assert both.count() == made[child].count() and both.where("c.created_at <= p.created_at").isEmpty()
    top = made["lines"].alias("l").join(made["orders"].alias("o"), F.col("l.order_id") == F.col("o.id")).join(made["customers"].alias("c"), F.col("o.customer_id") == F.col("c.id"))
    assert top.where("l.created_at >= c.updated_at").isEmpty()
    whole = made["notes"].alias("n").join(made["lines"].alias("l"), F.col("n.line_id") == F.col("l.id")).join(made["orders"].alias("o"), F.col("l.order_id") == F.col("o.id")).join(made["customers"].alias("c"), F.col("o.customer_id") == F.col("c.id"))
    assert whole.where("n.created_at > c.created_at + interval 1 day").isEmpty() and broken(made, cat) == []


def test_unknown_types_are_refused_where_rows_must_give_them(spark):
    cat = {"a": table("a", "id int, place point", "id"), "b": table("b", "id int, place point null, area polygon[] null", "id"), "c": Table("c", (Field("id", "int"), Field("place", "point", generated=True, nullable=True)), ("id",))}
    assert synthesis.refusals(cat) == {"a": "place has the type point, which is not known"}
    assert synthesis.generate(spark, cat, {})["b"].where("place is null and area is null").count() == 50


def random_catalog(r):
    """Tables of random types, checks, keys and references, parents first or in rings."""
    kinds = ["smallint", "int", "bigint", "numeric", "numeric(3,0)", "numeric(4,2)", "numeric(2,2)", "real", "double", "text", "varchar(3)", "varchar(12)", "varchar(80)", "char(2)", "uuid", "date", "time", "timestamp", "timestamptz", "interval", "boolean", "jsonb", "bytea", "inet", "enum(x|y|z)", "int[]", "varchar(5)[][]", "citext", "percent", "short[]"] * 3 + ["point"]
    names = ["id", "code", "email", "created_at", "updated_at", "country", "price", "percent", "status", "url", "title", "n", "html", "age"]
    out = {}
    tables = [f"t{i}" for i in range(5)]
    for i, name in enumerate(tables):
        fields = [Field(c, r.choice(kinds), r.random() < 0.35) for c in r.sample(names, r.randint(2, 6))]
        refs, checks = [], []
        for p in r.sample(tables[: i + 1] if r.random() < 0.9 else tables, k=min(i + 1, r.choice([0, 1, 1, 2, 3]))):
            if p in out and out[p].primary:
                own = [f"{p}_{k}" for k in out[p].primary] if r.random() < 0.6 else [f"ref_{k}" for k in out[p].primary]
                null = r.random() < 0.4
                kept = {f.name for f in fields}
                fields += [Field(c, out[p].field_of(k).type, null) for c, k in zip(own, out[p].primary, strict=True) if c not in kept]
                refs.append(Reference(tuple(own), p, out[p].primary, r.random() < 0.2))
            elif p == name and any(f.name == "id" for f in fields):
                fields.append(Field("up", next(f.type for f in fields if f.name == "id"), r.random() < 0.7))
                refs.append(Reference(("up",), name, ("id",)))
        columns = [f.name for f in fields]
        for j in range(r.choice([0, 1, 1, 2, 2])):
            f, k = r.choice(fields), r.choice([-40_000, -5, 0, 1, 5, 20, 99, 40_000])
            c, d = f.name, r.choice(columns)
            any_ = [f"({c} IS NOT NULL) OR ({d} IS NOT NULL)", f"num_nonnulls({c}, {d}) = 1" if c != d else f"{c} IS NOT NULL"]
            number = [f"{c} <= {k}", f"{c} >= {k}", f"({c} >= 5) AND ({c} <= {5 + abs(k) % 7})", f"{c} < {k}", f"{c} = ANY (ARRAY[1, 2, 40000])", f"{c} IN (1.5, 2)"]
            words = [f"char_length({c}) <= {abs(k)}", f"char_length({c}) >= {abs(k) % 30}", f"octet_length({c}) = {abs(k) % 40}", f"{c} = lower({c})", f"{c} <> ''", f"{c} IN ('x', 'Y')", f"{c} ~ 'x'"]
            kind = types.read(f.type)
            suited = number if kind.name in (*types.LIMITS, "numeric", "real", "double") else words if kind.name in types.TEXTS else [f"jsonb_typeof({c}) = 'boolean'"] if kind.name == "jsonb" else [f"octet_length({c}) = {abs(k) % 300}"] if kind.name == "bytea" else [f"cardinality({c}) <= 3"] if kind.of else any_
            checks.append((f"k{j}", r.choice(suited if r.random() < 0.8 else any_ if r.random() < 0.7 else [*number, *words])))
        key = tuple(r.sample(columns, r.choice([1, 1, 1, 2, 3]) if len(columns) > 2 else 1))
        fields = [Field(f.name, f.type, f.nullable and f.name not in key, sequence=f.name == "id" and f.type in ("int", "bigint", "smallint") and r.random() < 0.3) for f in fields]
        unique = tuple(tuple(r.sample(columns, r.choice([1, 2]))) for _ in range(r.choice([0, 0, 1, 2])))
        out[name] = Table(name, tuple(fields), key, unique, tuple(refs), tuple(checks), domains=(("short", "varchar(4)", ("char_length(VALUE) >= 2",)), ("percent", "int", ("VALUE > 0", "VALUE <= 100"))))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_random_catalogs_are_refused_or_break_no_rule(spark, seed):
    cat = random_catalog(random.Random(seed))
    refused = synthesis.refusals(cat)
    made = synthesis.generate(spark, cat, {n: 40 + 45 * i for i, n in enumerate(cat)}, seed)
    assert made.keys() == cat.keys() - refused.keys()
    assert broken(made, cat) == [], [(n, cat[n]) for n in {b[0] for b in broken(made, cat)}]
