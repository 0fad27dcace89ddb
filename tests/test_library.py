from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gneiss.functions import cells, nouns, shapes
from gneiss.operators import foreign_keys, graph, validate
from gneiss.plans import catalog_queries, synthesis
from gneiss.sources import shared
from gneiss.sources.catalog import SHOP, Reference, frames, from_struct, table
from gneiss.streaming import incremental


@pytest.mark.parametrize("wheels", [[40, 36], [7], [6, 12, 20], [1, 2]])
def test_odometer_takes_every_combination_once_and_neighbours_apart(spark, wheels):
    size = math.prod(wheels)
    digits, carry = nouns.odometer(F.col("id"), wheels)
    got = [(tuple(r[:-1]), r[-1]) for r in spark.range(2 * size).select(*digits, carry).collect()]
    assert len(set(got)) == 2 * size and {c for _, c in got} == {0, 1} and all(0 <= d < w for x, _ in got for d, w in zip(x, wheels, strict=True))
    if wheels == [40, 36]:
        assert all(sum(a != b for a, b in zip(x, y, strict=True)) == 2 for (x, _), (y, _) in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("noun", ["person", "email", "username", "city", "street", "company", "label", "slug", "host", "domain", "path", "file", "url", "version", "ident", "html", "title", "sentence", "state", "word"])
def test_nouns_stay_distinct_past_their_wheels(spark, noun):
    assert spark.range(9_000).select(nouns.noun(noun, F.col("id")).alias("v")).agg(F.count_distinct("v")).first()[0] == 9_000


@pytest.mark.parametrize(("noun", "size"), [("country_code", 20), ("extension", 12), ("phone", 100), ("ip", 762), ("color", 12)])
def test_closed_nouns_decline(spark, noun, size):
    assert spark.range(1_000).select(nouns.noun(noun, F.col("id")).alias("v")).agg(F.count("v"), F.count_distinct("v")).first()[:] == (size, size)


def test_vocabularies_are_ascii_distinct_and_sized():
    for words in (nouns.GIVEN, nouns.FAMILY, nouns.COMPANY, nouns.SUFFIX, nouns.CITY, nouns.COUNTRY, nouns.STREET, nouns.WORD, nouns.TITLE, nouns.SENTENCE, nouns.STATE):
        assert all(w.isascii() and not w.rsplit("-")[-1].isdigit() for w in words) and len({w.lower() for w in words}) == len(words)
    assert (len(nouns.GIVEN), len(nouns.FAMILY), len(nouns.COMPANY), len(nouns.CITY), len(nouns.COUNTRY), len(nouns.STREET), len(nouns.TITLE), len(nouns.SENTENCE)) == (40, 36, 24, 32, 20, 24, 24, 24)


def test_cell_hash_and_base36(spark):
    r = spark.range(1).select(cells.cell(1, "public/t", "c", F.lit(0)).alias("h"), cells.base36(F.lit(1679615)).alias("z")).first()
    assert (r.h, r.z) == (424708376492500091, "zzzz")


def test_moments_keep_their_order(spark):
    at = [nouns.moment(F.col("id"), cells.cell(1, "t", b, F.col("id")), b).alias(b) for b in ("opened", "touched", "closed")]
    assert spark.range(5_000).select(*at).where("not (opened < touched and touched < closed)").isEmpty()
    assert spark.range(5_000).select(at[0]).distinct().count() == 5_000


def test_values_do_not_depend_on_partitioning(spark):
    plan = synthesis.plans(SHOP, synthesis.sizes(SHOP, {}, 300), 5)["orders"]
    one, many = plan.frame(spark, 1), plan.frame(spark, 7)
    assert one.exceptAll(many).isEmpty() and many.count() == 300


def test_adding_a_table_moves_nothing(spark):
    more = SHOP | {"extra": table("extra", "id int, order_id int", "id", (), (("order_id", "orders", "id"),))}
    a, b = (synthesis.generate(spark, c, {}, 3)["payments"] for c in (SHOP, more))
    assert a.exceptAll(b).isEmpty()


@pytest.mark.parametrize("rows", [1, 7, 400])
def test_generated_tables_break_no_rule(spark, rows):
    made = synthesis.generate(spark, SHOP, dict.fromkeys(SHOP, rows), 11)
    assert len(made) == 14
    assert validate.report({n: SHOP[n] for n in made}, made.__getitem__).agg(F.sum("violations")).first()[0] == 0


def test_checks_pass_on_null_and_true(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    assert df.where(validate.failed("x > 0")).collect()[0].x == -1


def test_null_keys_are_distinct_and_null_references_are_not_followed(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5), (2, 5)], "a int, b int")
    assert [tuple(r) for r in validate.duplicates(df, ("a", "b")).collect()] == [(2, 5, 2)]
    parent = spark.createDataFrame([(5,)], "id int")
    child = spark.createDataFrame([(5,), (6,), (None,)], "p int")
    assert [r.p for r in validate.orphans(child, Reference(("p",), "parent", ("id",)), parent).collect()] == [6]


def test_unread_checks_refuse_and_the_probe_rescues(spark):
    t = {"t": table("t", "id bigint, slug text", "id", (), (), (("slug", "slug rlike '^[a-z0-9-]+$'"),))}
    assert synthesis.sizes(t, {}) == {}
    plain = {"t": table("t", "id bigint, slug text", "id")}
    assert synthesis.probe(synthesis.generate(spark, plain, {}), t) == {}
    strict = {"t": table("t", "id bigint, slug text", "id", (), (), (("slug", "slug = 'x'"),))}
    assert synthesis.probe(synthesis.generate(spark, plain, {}), strict) == {"t": {"check:slug": 50}}


def test_numbered_has_no_gaps(spark):
    df = spark.range(1_000).select((F.col("id") * 7919 % 1_009).alias("k"))
    rows = foreign_keys.numbered(df, ["k"]).orderBy("k").collect()
    assert [r.row for r in rows] == list(range(1_000))


def test_hierarchy_has_one_root(spark):
    df = foreign_keys.rooted(spark.range(3, 20), "id", "boss")
    assert validate.roots(df, "boss").first().roots == 1 and df.where("boss = id").isEmpty()


def test_levels_are_null_above_a_cycle(spark):
    cat = {n: table(n, "id int, r int", "id", (), (("r", r, "id"),)) for n, r in (("a", "b"), ("b", "a"), ("c", "a"))} | {"d": table("d", "id int", "id")}
    f = frames(spark, cat)
    got = {r.table_name: r.level for r in graph.levels(f["tables"], graph.edges(f["references"], f["tables"])).collect()}
    assert got == {"a": None, "b": None, "c": None, "d": 0}


def test_conjuncts_split_and_only_and(spark):
    df = spark.createDataFrame([("CHECK (((a >= 1) AND (a <= 5)))",), ("CHECK (((a >= 1) OR (a <= 5)))",)], "c string")
    assert [r[0] for r in df.select(F.size(shapes.conjuncts(F.col("c")))).collect()] == [2, 1]


def test_triggers_that_assign_with_an_equals_sign(spark):
    bodies = ["BEGIN NEW.a = 1; IF NEW.b = 2 THEN NEW.c = 3; ELSE NEW.d := 4; END IF; x = NEW.e; RETURN NEW; END", "BEGIN IF NEW.b = 2 THEN RETURN NEW; END IF; NEW.id = nextval('s'); RETURN NEW; END"]
    got = [r[0].assigns for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(shapes.trigger(F.col("b"))).collect()]
    assert got == ["a,c,d", ""]


def test_publish_is_all_or_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    assert shared.publish({"a": spark.range(3), "b": spark.range(2)}, path) == {"a": 3, "b": 2}
    with pytest.raises(ValueError, match="have rows"):
        shared.publish({"a": spark.range(9)}, path)
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(Exception):
        shared.publish({"a": spark.range(9), "b": bad}, path, overwrite=True)
    assert shared.read(spark, path, "a").count() == 3
    real, calls = shared.moved, []

    def failing(spark, source, target):
        calls.append(target)
        if target.endswith("out/b.parquet") and len(calls) <= 4:
            raise OSError("no")
        real(spark, source, target)

    monkeypatch.setattr(shared, "moved", failing)
    with pytest.raises(OSError, match="no"):
        shared.publish({"a": spark.range(9), "b": spark.range(9), "c": spark.range(1)}, path, overwrite=True)
    monkeypatch.undo()
    assert [shared.read(spark, path, n).count() for n in ("a", "b")] == [3, 2] and not (tmp_path / "out" / "c.parquet").exists()
    assert shared.publish({"a": spark.range(9), "b": spark.range(8)}, path, overwrite=True) == {"a": 9, "b": 8}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.parquet", "b.parquet"]
    with pytest.raises(ValueError, match="not on this machine"):
        shared.publish({"a": spark.range(1)}, "s3://bucket/x")


def test_catalog_from_a_frame(spark):
    t = from_struct("x", spark.range(1).schema, ("id",))
    assert t.fields[0].name == "id" and t.keys == (("id",),)


def test_stream_finds_broken_rows_and_counts_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(dt.datetime(2024, 1, 1, 0, m), "a" if m % 2 else "b", m - 5) for m in range(60)]
    spark.createDataFrame(rows, "ts timestamp, kind string, value int").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, kind string, value int").parquet(src)
    q = incremental.broken(stream, {"positive": "value >= 0"}).writeStream.format("memory").queryName("broken").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("broken").count() == 5
    q = incremental.counted(stream, "ts", "kind").writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.kind, r.rows) for r in spark.table("counted").collect()} == {("a", 30), ("b", 30)}


def test_cycles_have_one_root_each_and_no_closed_loop(spark):
    rings = {t.name: t for t in (table("a", "id int, b int null", "id", (), (("b", "b", "id"),)), table("b", "id int, a int", "id", (), (("a", "a", "id"),)), table("own", "id int, up int", "id", (), (("up", "own", "id"),)), table("x", "id int, y int", "id", (), (("y", "y", "id deferrable"),)), table("y", "id int, x int", "id", (), (("x", "x", "id deferrable"),)), table("over", "id int, x int, gone int null", "id", (), (("x", "x", "id"), ("gone", "nowhere", "id"))))}
    assert synthesis.order(rings) == ["own", "a", "b", "x", "y", "over"] or synthesis.order(rings)[-1] == "over"
    made = synthesis.generate(spark, rings, {"y": 5})
    assert made.keys() == rings.keys() and synthesis.refusals(rings) == {}
    a, b = ({r[0]: r[1] for r in made[n].collect()} for n in "ab")
    for start in a:
        at, steps = start, 0
        while at is not None and steps < 10:
            at, steps = (b[a[at]] if a[at] is not None else None), steps + 1
        assert at is None
    assert sum(v is None for v in a.values()) == 1 and made["own"].where("up is null").isEmpty() and made["over"].where("gone is not null").isEmpty()
    for n, df in made.items():
        for ref in rings[n].references:
            assert ref.table == "nowhere" or validate.orphans(df, ref, made[ref.table]).isEmpty()


def test_a_cycle_through_a_key_is_refused(spark):
    rings = {t.name: t for t in (table("x", "y int", "y", (), (("y", "y", "id deferrable"),)), table("y", "id int, x int", "id", (), (("x", "x", "y deferrable"),)))}
    assert synthesis.refusals(rings) == {"x": "has a key with its reference to y, which refers back", "y": "needs x, which is refused"}
    assert synthesis.generate(spark, rings, {}) == {}


def test_selection_brings_parents_unless_they_are_excluded(spark):
    assert set(synthesis.selected(SHOP, ["order_items"])) == {"order_items", "orders", "products", "users", "orgs"}
    assert set(synthesis.selected(SHOP)) == set(SHOP)
    left = synthesis.selected(SHOP, ["order_items"], ["products"])
    assert "products" not in left and synthesis.refusals(left) == {"order_items": "needs products, which is not in the catalog"}
    assert set(synthesis.generate(spark, left, {})) == {"orders", "users", "orgs"}


def test_profile_counts_equal_cells_first(spark, monkeypatch):
    """Nulls, repeats and empty tables; no plan that keeps the values of all columns beside one another."""
    monkeypatch.setattr(catalog_queries, "PROFILE_ROWS", 3)
    rows = [(i % 7, None if i % 4 == 0 else f"v{i}", "same") for i in range(20)] + [(None, None, "same")] * 3
    df = spark.createDataFrame(rows, "a long, b string, c string")
    out = catalog_queries.profile(df)
    assert {tuple(r) for r in out.collect()} == {("a", 7, 3, "0", "6"), ("b", 15, 8, "v1", "v9"), ("c", 1, 0, "same", "same")}
    assert {tuple(r) for r in catalog_queries.profile(df.where("false")).collect()} == {(n, 0, 0, None, None) for n in "abc"}


def test_value_profile_spreads_its_rows(spark, capsys):
    catalog_queries.value_profile(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "Expand" not in plan and "REPARTITION_BY_NUM" in plan
