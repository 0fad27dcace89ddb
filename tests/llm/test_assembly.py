"""WARC, mixing, packing, running numbers and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gneiss.llm import mixing, packing, warc
from gneiss.llm.ranks import running
from gneiss.llm.tokens import Encoder

from .conftest import frame

PAGES = "page_id long, url string, html string, digest string, size int, k string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "x") for r in rows], PAGES)


ROWS = [(3, "http://a/1", "<p>one</p>"), (1, "http://a/2", "<p>one</p>"), (2, "http://a b/\n3", "two\r\n\r\nlines é😀"), (7, None, None), (5, "http://a/5", ""), (6, "http://a/6", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"), (9, "http://a/9", "x" * 300_000)]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 1, 100])
def test_archives_round_trip(spark, tmp_path, least):
    path = str(tmp_path / f"w{least}")
    warc.write(pages(spark, ROWS).repartition(3), path, min_bytes=least, records_per_file=4)
    got = {int(r.metadata.page_id): r for r in warc.resolved(warc.assemble(warc.read(spark, path))).collect()}
    assert len(got) == len(ROWS)
    for page, url, html in ROWS:
        r, body = got[page], (html or "").encode()
        first = min(p for p, _, t in ROWS if (t or "") == (html or ""))
        again = first != page and len(body) >= least
        assert r.response.type == ("revisit" if again else "response")
        assert (r.response.payload_bytes, r.response.payload_digest) == (len(body), sha(html))
        assert bytes(r.response.payload) == (b"" if again else body)
        assert r.refers_to_page == (str(first) if again else None) and r.copies == 1
        assert r.response.refers_to == (got[first].capture_id if again else None)
        assert r.request.record_id and r.response.uri == (url or "about:blank").replace(" ", "%20").replace("\n", "%20")


def test_files_are_plain_warc(spark, tmp_path):
    path = tmp_path / "w"
    warc.write(pages(spark, ROWS).coalesce(1), str(path), records_per_file=5)
    files = sorted(path.glob("*.gz"))
    assert len(files) >= 4
    data = gzip.decompress(files[0].read_bytes())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")
    kinds = Counter(h["warc-type"] for f in files for h, _ in warc.parse(f.read_bytes()))
    assert kinds == {"request": 7, "metadata": 7, "response": 5, "revisit": 2}
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(data[:-20]))


def test_transactions_without_all_records(spark):
    rows = [("r1", "response", None), ("q1", "request", "r1"), ("r2", "revisit", None), ("m3", "metadata", "r3"), ("r1", "response", None)]
    df = spark.createDataFrame(rows, "record_id string, type string, concurrent_to string").select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("refers_to", "string"), ("uri", "string"), ("date", "string"), ("digest", "string"), ("headers", "map<string,string>"), ("payload_bytes", "long"), ("payload_digest", "string"), ("payload", "binary"))])
    got = {r.capture_id: r for r in warc.assemble(df).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"].request.record_id == "q1" and got["r2"].request is None


def test_archive_query_of_nothing_repeats_and_null_keys(spark, tmp_path):
    rows = [(1, "u", "x"), (1, "u", "x"), (1, "v", "x"), (None, "u", "x"), (2, "u", "x"), (1, "u", "other"), (None, "u", "alone"), (None, "w", "alone"), (None, None, None), (-3, "u", "")]
    for name, made in (("none", []), ("repeat", rows)):
        pages(spark, made).write.parquet(f"{tmp_path}/{name}/pages.parquet")
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op10_warc(spark, f"{tmp_path}/{name}").collect()]
        want = []
        for page, _, html in made:
            keys = [p for p, _, t in made if (t or "") == (html or "") and p is not None]
            least = min(keys, default=None)
            want.append((page, len(html or ""), sha(html), "response" if page == least else "revisit", None if page == least else least))
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(got, key=key) == sorted(want, key=key)


def test_files_are_cut_by_bytes(spark, tmp_path):
    rows = [(i, f"http://a/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 500) for i in range(60)]
    path = tmp_path / "bytes"
    warc.write(pages(spark, rows), str(path), file_bytes=200_000)
    sizes = [sum(len(b) for _, b in warc.parse(f.read_bytes())) for f in path.glob("*.gz")]
    assert len(sizes) >= 6 and max(sizes) < 800_000 and sum(sizes) > 60 * 32_000
    got = {int(r.metadata.page_id): bytes(r.response.payload).decode() for r in warc.assemble(warc.read(spark, str(path))).collect()}
    assert got == {i: t for i, _, t in rows}


# Running numbers ---------------------------------------------------------------------
def test_rows_that_share_a_name_are_dealt_over_partitions(spark):
    rows = [(None, "u", "x" * 2_000)] * 400 + [(i, f"u{i}", f"y{i}" * 300) for i in range(100)] + [(7, "u", "x" * 2_000)]
    df = spark.createDataFrame(rows, "k long, u string, b string").repartition(3)
    got = warc.mark_revisits(df, part_bytes=100_000)
    sizes = [n for n in got.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
    assert sum(sizes) == len(rows) and max(sizes) < 160
    assert got.where("first is not null").count() == 400 and got.where("k is not null and first is not null").count() == 0


def test_running_places_have_no_gaps(spark, monkeypatch):
    monkeypatch.setattr("gneiss.llm.ranks.SLICE_ROWS", 50)
    df = spark.range(2_000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "cold").alias("g"), (F.col("id") % 5).alias("w"))
    rows = running(df, "g", ["id"]).collect()
    for g in ("hot", "cold", None):
        assert sorted(r.place for r in rows if r.g == g) == list(range(sum(r.g == g for r in rows)))
    total = {}
    for r in sorted(running(df, "g", ["id"], "w").collect(), key=lambda r: (str(r.g), r.place, r.w)):
        assert r.place <= total.get(r.g, 0) or r.place == total[r.g]
        total[r.g] = max(total.get(r.g, 0), r.place + r.w)
    assert total == {g: sum(r.w for r in rows if r.g == g) for g in ("hot", "cold", None)}


# Mixing ------------------------------------------------------------------------------
@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1, "c": 1}, {"a": 5, "b": 3, "c": 2, "d": 0.01}, {f"s{i}": 1 + i for i in range(20)}])
def test_frames_are_pfair(weights):
    slots = mixing.shares(weights, 1_000)
    frame_, at = sum(slots.values()), mixing.frame_slots(slots)
    assert sorted(t for x in at.values() for t in x) == list(range(frame_))
    for s, k in slots.items():
        for j, t in enumerate(at[s]):
            assert j * frame_ // k <= t < -(-(j + 1) * frame_ // k)
        given = np.cumsum(np.isin(np.arange(frame_), at[s]))
        assert np.all(np.abs(given - (np.arange(frame_) + 1) * k / frame_) < 1)


def brute_schedule(weights, n):
    """Slot by slot, the earliest deadline among released blocks, in exact fractions of the weights as written."""
    w = {s: Fraction(str(x)) for s, x in weights.items() if x > 0}
    w = {s: x / sum(w.values()) for s, x in w.items()}
    done, out = dict.fromkeys(w, 0), {}
    for t in range(n):
        _, _, s = min((math.ceil((done[s] + 1) / w[s]), -w[s], s) for s in w if math.floor(done[s] / w[s]) <= t)
        out[s, done[s]] = t
        done[s] += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 0.7, "b": 0.2, "c": 0.0996, "d": 0.0004}, {"a": 0.1, "b": 0.7, "c": 1.3}, {"a": 1, "b": 99_000}])
def test_no_source_is_ever_a_block_away_from_its_exact_weight(weights):
    k = mixing.ratio(weights, 100_000)
    size, at, n = sum(k.values()), mixing.frame_slots(k), 100_000
    owner = np.empty(size, object)
    for s, x in at.items():
        owner[x] = s
    order = np.tile(owner, -(-n // size))[:n]
    total = sum(Fraction(str(w)) for w in weights.values())
    for s, w in weights.items():
        assert np.max(np.abs(np.cumsum(order == s) - np.arange(1, n + 1) * float(Fraction(str(w)) / total))) < 1
    want = brute_schedule(weights, 3_000)
    assert all(order[t] == s for (s, _), t in want.items())


def test_ratios():
    assert mixing.ratio({"a": 0.5, "b": 0.25, "c": 0.25, "d": 0}, 100) == {"a": 2, "b": 1, "c": 1}
    assert mixing.ratio({"a": 1 / 3, "b": 0.7}, 100) == mixing.shares({"a": 1 / 3, "b": 0.7}, 100) and mixing.ratio({}, 9) == {}


def test_schedule_equals_slot_by_slot(spark, prose):
    rows = [(i, prose(i, 20 + i % 50), "en", f"s{min(3, i % 10)}") for i in range(400)] + [(500, None, "en", "s0"), (501, "abc", "en", None), (502, "", "en", "s1"), (None, "x", "en", "s2")]
    how = mixing.Mix(block_chars=700)
    weights = {"s0": 3, "s1": 2, "s2": 1, "s3": 4, "": 0.0, "none": 9}
    got = mixing.schedule(frame(spark, rows, extra=True), weights, how).collect()
    assert len(got) == len(rows)
    want = brute_schedule({s: w for s, w in weights.items() if s != "none"}, 2_000)
    blocks = {s: {r.block for r in got if r.source == s} for s in ("s0", "s1", "s2", "s3")}
    # A document is of the block that it begins in; a long last one may reach into blocks of its own.
    count = {s: max(0, sum(len(t or "") for _, t, _, x in rows if x == s) - 1) // 700 + 1 for s in blocks}
    assert all(max(b) < count[s] and len(b) > count[s] * 0.6 for s, b in blocks.items())
    end = min(want[s, n] for s, n in count.items())
    for r in got:
        if r.source == "":
            assert r.slot is None and not r.in_mix
        else:
            assert r.slot == want[r.source, r.block] and r.in_mix == (r.slot < end)
    size = Counter()
    text = {i: len(t or "") for i, t, *_ in rows}
    for r in got:
        if r.in_mix:
            size[r.source] += text[r.doc_id]
    assert all(abs(size[s] / sum(size.values()) - w / 10) < 0.05 for s, w in (("s0", 3), ("s1", 2), ("s2", 1), ("s3", 4)))


def test_mix_of_nothing_and_of_whole_rows(spark, corpus):
    assert mixing.schedule(frame(spark, [])).count() == 0
    docs = frame(spark, corpus, extra=True)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and 0 < out.count() <= len(corpus)
    assert mixing.schedule(docs, {}).where("in_mix").count() == 0 and mixing.schedule(docs, {"s0": 1}).where("slot is null and source <> 's0'").count() > 0


def test_a_source_of_one_document_does_not_end_the_mix(spark, prose):
    rows = [(i, prose(i, 20 + i % 50), "en", f"s{min(3, i % 10)}") for i in range(600)] + [(900, "one", "en", "lone"), (901, prose("null", 30), "en", None)]
    how = mixing.Mix(block_chars=300, parts=50)
    got = mixing.schedule(frame(spark, rows), how=how).collect()
    assert len(got) == len(rows) and all(r.in_mix for r in got)
    assert sorted(r.doc_id for r in mixing.mixed(frame(spark, rows), how=how).collect()) == sorted(i for i, *_ in rows)
    chars = Counter()
    for _, text, _, s in rows:
        chars[s or ""] += len(text)
    blocks = {s: (n - 1) // 300 + 1 for s, n in chars.items()}
    weights = mixing.shares({s: n**how.power for s, n in chars.items()}, 50)
    # Every block has a slot of its own, without gaps, and blocks of a source follow one another.
    slot_of = {(s, j): start + (j - first) // k * size + at[(j - first) % k] for s, first, after, start, k, size, at in mixing.segments(blocks, weights, how) for j in range(first, after)}
    assert set(slot_of) == {(s, j) for s, n in blocks.items() for j in range(n)}
    assert sorted(slot_of.values()) == list(range(sum(blocks.values())))
    assert all(slot_of[s, j] < slot_of[s, j + 1] for s, n in blocks.items() for j in range(n - 1))
    assert all(r.slot == slot_of[r.source, r.block] for r in got)
    # While several sources last, each is near its share of those that are left.
    order = [s for (s, _), _ in sorted(slot_of.items(), key=lambda x: x[1])]
    left, want, given = Counter(blocks), Counter(), Counter()
    for s in order:
        total = sum(weights[x] for x in left if left[x])
        for x in left:
            if left[x]:
                want[x] += weights[x] / total
        given[s] += 1
        left[s] -= 1
    assert all(abs(want[s] - blocks[s]) < 0.1 * blocks[s] + 3 for s in blocks)


def test_mixed_stands_in_the_order_of_slots(spark, corpus):
    docs = frame(spark, corpus)
    how = mixing.Mix(block_chars=700, parts=50)
    slot = {}
    for r in mixing.schedule(docs.where("doc_id is not null"), how=how).collect():
        slot[r.doc_id] = min(r.slot, slot.get(r.doc_id, r.slot))
    out = [r.doc_id for r in mixing.mixed(docs, how=how).collect()]
    assert Counter(out) == Counter(i for i, *_ in corpus)
    known = [i for i in out if i is not None]
    assert out[: len(known)] == known and known == sorted(known, key=lambda i: (slot[i], i))


# Packing ------------------------------------------------------------------------------
def test_encoder_gives_the_tokenizers_ids(corpus):
    e = Encoder(packing.vocabulary())
    odd = ["It's Bob's; they'll we've 'sam ''s I'M 'd'd x'", "áb café 12345 3.14", "<|endoftext|> x", "ΣΑΣ İx", "\x1c a\x85b\xa0c", "日本語 text", "don't!'re —'s'", "'", "a\n\n b\t c", "Ünïcode’s “quotes” 5€ №5 ½ ²", "x" * 5_000]
    texts = [*odd, *[t for _, t, *_ in corpus]]
    plain = e._t.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for _ in range(2):
        assert [x.tolist() for x in e(texts)] == [p.ids for p in plain]


def check_packed(rows, got, how):
    e = Encoder(packing.vocabulary())
    ids = {}
    for i, text, *_ in rows:
        ids.setdefault(i, []).append(np.append(e([text])[0], np.uint32(how.end_id)).astype("<u4"))
    fill = {}
    for r in got:
        assert 1 <= r.length and r.start + r.length <= r.doc_tokens
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in ids[r.doc_id])
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(x) for xs in ids.values() for x in xs)
    for i, xs in ids.items():
        pieces = Counter((r.start, r.length) for r in got if r.doc_id == i)
        assert sum(n * k for (_, k), n in pieces.items()) == sum(len(x) for x in xs)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= how.length
    return 1 - sum(r.length for r in got) / (len(fill) * how.length)


@pytest.mark.parametrize("how", [packing.Pack(), packing.Pack(256, 4), packing.Pack(64, 1)])
def test_packs_hold_every_id_once(spark, corpus, how):
    got = packing.pack(frame(spark, corpus, extra=True), how).collect()
    waste = check_packed(corpus, got, how)
    assert waste < 0.25 and sorted({r.sequence_id for r in got}) == list(range(len({r.sequence_id for r in got})))


def test_pack_of_nothing_and_of_one(spark):
    assert packing.pack(frame(spark, [])).count() == 0
    (r,) = packing.pack(frame(spark, [(1, None, "en", "s")])).collect()
    assert (r.start, r.length, r.doc_tokens, r.sequence_id, r.offset) == (0, 1, 1, 0, 0)


def test_packs_in_order_follow_the_rows(spark, corpus, tmp_path):
    """No sequence crosses the spans of the order, sequences follow the first rows that they hold, and every id is held once."""
    how = packing.Pack(64, 1, span=20)
    rows = random.Random(4).sample([r for r in corpus if r[0] is not None and r[0] != 59], 60)
    frame(spark, rows, extra=True).coalesce(1).sortWithinPartitions(F.rand(5)).write.option("maxRecordsPerFile", 11).parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    order = [r.doc_id for f in sorted((tmp_path / "docs").glob("part-*")) for r in spark.read.parquet(str(f)).collect()]
    got = packing.pack_in_order(docs, how).collect()
    assert check_packed(rows, got, how) < 0.1
    at, total = {}, 0
    tokens = {r.doc_id: r.doc_tokens for r in got}
    for i in order:
        at[i], total = total, total + tokens[i]
    spans = round(total / (20 * 64))
    assert spans > 3
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((at[r.doc_id] + r.start, r.offset))
    assert sorted(held) == list(range(len(held)))
    assert all(len({p // -(-total // spans) for p, _ in x}) == 1 and sorted(x) == sorted(x, key=lambda p: p[1]) for x in held.values())
    assert [min(held[i]) for i in sorted(held)] == sorted(min(x) for x in held.values())


def test_packs_in_order_of_nothing_and_of_frames(spark):
    assert packing.pack_in_order(frame(spark, [])).count() == 0
    docs = frame(spark, [(i, "a b c", "en", "s") for i in (5, None, 3)]).coalesce(1)
    assert [(r.doc_id, r.sequence_id) for r in sorted(packing.pack_in_order(docs).collect(), key=lambda r: r.offset)] == [(5, 0), (None, 0), (3, 0)]


def brute_knapsack(prices, capacity):
    best = [0.0] * (capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max([best[c - 1], *(prices[k - 1] + best[c - k] for k in range(1, min(c, len(prices)) + 1))])
    return best[capacity]


def test_knapsack_and_plan_against_plain_ones():
    r = np.random.default_rng(3)
    for _ in range(20):
        prices = r.random(24) * (r.random(24) < 0.5)
        value, pattern = packing.knapsack(prices, 24)
        assert value == pytest.approx(brute_knapsack(prices, 24)) and pattern @ prices == pytest.approx(value) and pattern @ np.arange(1, 25) <= 24
    for _ in range(8):
        demand = r.integers(0, 400, 64) * (r.random(64) < 0.7)
        made = packing.plan(demand).patterns
        assert (sum(n * p for p, n in made) == demand).all() and all(p @ np.arange(1, 65) <= 64 for p, _ in made)
        least = -(-int(demand @ np.arange(1, 65)) // 64)
        # First-fit decreasing, for comparison.
        bins: list[int] = []
        for size in [k + 1 for k in range(63, -1, -1) for _ in range(demand[k])]:
            i = next((i for i, room in enumerate(bins) if room >= size), None)
            bins.append(64 - size) if i is None else bins.__setitem__(i, bins[i] - size)
        assert least <= sum(n for _, n in made) <= len(bins) + 1
    assert packing.plan(np.zeros(8, np.int64)).patterns == []


@pytest.mark.parametrize("shape", ["gamma", "uniform", "two peaks", "thirds"])
def test_plans_are_near_their_bound(shape):
    r = np.random.default_rng(5)
    lengths = {
        "gamma": r.gamma(2, 60, 50_000) + 1, "uniform": r.integers(1, 513, 50_000),
        "two peaks": np.where(r.random(50_000) < 0.5, r.normal(140, 15, 50_000), r.normal(230, 20, 50_000)), "thirds": r.integers(120, 260, 50_000),
    }[shape]
    demand = np.bincount(np.clip(lengths.astype(int), 1, 512), minlength=513)[1:]
    made = packing.plan(demand)
    assert (sum(n * p for p, n in made.patterns) == demand).all() and all(p @ np.arange(1, 513) <= 512 for p, _ in made.patterns)
    assert demand @ np.arange(1, 513) / 512 <= made.bound <= made.sequences <= 1.02 * made.bound + 1


# The pipeline ---------------------------------------------------------------------------
def test_stages_run_and_keep_the_columns(spark, tmp_path, corpus):
    docs = frame(spark, [*corpus, (900, "write to some.one@example.com or call +1 (555) 010-9999 today please", "en", "s1")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names, now = docs.columns, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names and out.dtypes == docs.dtypes, name
            out.write.parquet(f"{tmp_path}/{i}")
            now = spark.read.parquet(f"{tmp_path}/{i}")
            if name == "near_duplicates":
                kept = {r.doc_id for r in now.collect()}
                assert not kept & set(range(100, 108)) and set(range(60)) <= kept
            if name == "personal_data":
                texts = {r.doc_id: r for r in now.collect()}
                assert "@" not in texts[900].text and texts[900].n_chars == len(texts[900].text)
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert last.count() > 0 and {r.doc_id for r in last.collect()} <= {r.doc_id for r in now.collect()} | {None}


def chained(spark, docs, folder):
    """The frames that the stages give, each written and read again."""
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        out.append(docs)
    return out


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = frame(spark, [])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = chained(spark, docs, tmp_path)
    assert [df.count() for df in got] == [0] * 5 and all(df.columns == docs.columns for df in got[:4])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_mix_orders_the_sequences(spark, tmp_path, prose):
    """The sequences begin with the mix's first document; packed without the mix, with the table's."""
    rows = [(i, prose(i, 1_000), "en", "ab"[i >= 60]) for i in range(120)]
    docs = frame(spark, rows)
    docs.coalesce(1).write.parquet(f"{tmp_path}/plain")
    corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/mixed")
    plain, mixed = ([r for r in corpus_pipeline.pack_sequences(spark, spark.read.parquet(f"{tmp_path}/{x}"), str(tmp_path)).collect()] for x in ("plain", "mixed"))
    assert sum(r.length for r in plain) == sum(r.length for r in mixed)
    first = lambda got, n: sorted({r.doc_id for r in got if r.start == 0}, key=lambda i: min((r.sequence_id, r.offset) for r in got if r.doc_id == i))[:n]
    slot = {r.doc_id: r.slot for r in mixing.schedule(docs).collect()}
    assert first(plain, 1) == [0] and first(mixed, 1) == [min(slot, key=lambda i: (slot[i], i))]
    assert {r.doc_id: r.sequence_id for r in plain} != {r.doc_id: r.sequence_id for r in mixed}


def test_pipeline_with_clashing_columns_equals_the_chain_in_plain_python(spark, tmp_path, prose):
    """Without labels all documents are kept; copies, personal data, order and tokens are worked out document by document."""
    texts = [f"{prose(i, 50)} mail user{i}@example.com now" for i in range(12)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)] + [(20 + i, texts[i], "en", "s1") for i in range(4)] + [(30, None, "en", "s0"), (31, "", None, None)]
    docs = frame(spark, rows, extra=True)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, single, clean, ordered, packed = chained(spark, docs, tmp_path)
    assert all(df.columns == docs.columns for df in (kept, single, clean, ordered))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_ in rows)
    left = {i: t for i, t, *_ in rows if i < 20 or i >= 30}  # of equal texts the least doc_id
    assert {r.doc_id: r.text for r in single.collect()} == left
    want = {i: None if t is None else t.replace(f"user{i}@example.com", "<EMAIL>") for i, t in left.items()}
    assert {r.doc_id: (r.text, r.n_chars, r.block) for r in clean.collect()} == {i: (t, None if t is None else len(t), "x") for i, t in want.items()}
    assert {r.doc_id: r.text for r in ordered.collect()} == want
    e = Encoder(packing.vocabulary())
    pieces = packed.collect()
    assert {i: sum(r.length for r in pieces if r.doc_id == i) for i in want} == {i: len(e([t])[0]) + 1 for i, t in want.items()}
