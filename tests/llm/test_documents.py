"""Fingerprints, licenses, quality rules and the quality classifier."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gneiss.llm import cotraining, fingerprint, licenses, quality_rules
from gneiss.llm.words import batch

from .conftest import frame


# Fingerprints ------------------------------------------------------------------
def h(value, seed=42):
    data = value.encode() if isinstance(value, str) else int(value).to_bytes(4 if isinstance(value, np.int32) else 8, "little", signed=True)
    x = xxhash.xxh64(data, seed=seed).intdigest()
    return x - (1 << 64) if x >> 63 else x


def chained(values):
    seed = 42
    for v in values:
        seed = h(v, seed % (1 << 64))
    return seed


def brute_fingerprint(text, how=fingerprint.Order()):
    """Bins of items (hash of k-mer and occurrence number), least first; tuples in text order."""
    words = [w.decode() for w in (text or "").encode().split()]
    if not words:
        return {}
    bits = how.bins.bit_length() - 1
    size = 1 << (bits + fingerprint.HASH_BITS)
    count, bins = Counter(), {}
    hashes = [h(w) for w in words]
    for i in range(max(1, len(words) - how.k + 1)):
        kmer = chained(hashes[i : i + how.k]) if how.k > 1 else hashes[i]
        kmer %= size
        item = (chained([kmer, np.int32(count[kmer])]) % size) if count[kmer] else kmer
        bins.setdefault(item >> fingerprint.HASH_BITS, []).append((item, i))
        count[kmer] += 1
    return {b: [x for x, _ in sorted(sorted(items)[: how.items], key=lambda x: x[1])] for b, items in bins.items()}


def test_fingerprints_select_the_least_items_in_text_order(spark, corpus, prose):
    rows = [*corpus, (700, "a b a b a b c", "en", "s"), (701, " ".join(["to"] * 50), "en", "s"), (702, prose("x", 900, 30), "en", "s")]
    docs = frame(spark, rows, extra=True)
    got = {r.doc_id: r.f for r in fingerprint.fingerprint(docs, "text", "f").select("doc_id", "f").collect()}
    seen = {}
    for i, text, *_ in rows:
        if i is None:
            continue
        want = brute_fingerprint(text)
        assert [e >> 32 for e in got[i]] == sorted(want)
        for e in got[i]:  # one entry for one tuple, over all texts
            key = (e >> 32, tuple(want[e >> 32]))
            assert seen.setdefault(key, e) == e
    assert len(set(seen.values())) == len(seen)


def test_likeness_follows_order_and_overlap(spark, prose):
    a = prose("a", 300)
    w = a.split()
    swapped = " ".join(w[150:] + w[:150])
    rows = spark.createDataFrame([(a, a), (a, " ".join([*w[:290], *("x" * 3).split()])), (a, swapped), (a, prose("b", 300)), ("", ""), ("", a), (None, None)], "x string, y string")
    both = fingerprint.fingerprint(fingerprint.fingerprint(rows, "x", "f"), "y", "g")
    same, edited, turned, other, empty, one, null = (r[0] for r in both.select(fingerprint.likeness(F.col("f"), F.col("g"))).collect())
    assert same == 1 and empty == 1 and null == 1 and one == 0 and other < 0.05 and edited > 0.8 and turned < edited


@pytest.mark.parametrize("per_block", [40, 4 << 20])
def test_edited_texts_take_from_the_next_smaller_id(spark, tmp_path, monkeypatch, per_block):
    rows = [(i * i, f"text {i} " + "é😀z"[: i % 4] * i, "en", "s") for i in range(40)] + [(-5, None, "en", "s"), (5_000_000, "far away", "en", "s"), (-(1 << 63), "least", "en", "s"), ((1 << 63) - 1, "largest of all ids", "en", "s")]
    path = str(tmp_path / f"d{per_block}")
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    monkeypatch.setattr(fingerprint.followed, "__defaults__", (per_block, 50_000))
    got = {r.doc_id: r for r in fingerprint.op3_fingerprint(spark, path).collect()}
    order = sorted(((i, t or "") for i, t, *_ in rows), reverse=True)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (brute_fingerprint(t) for t in (text, edited, after))
        for x, y, near in ((a, b, got[i].near_edited), (a, c, got[i].near_next)):
            either = len(x.keys() | y.keys())
            assert near == pytest.approx(sum(x[k] == y.get(k) for k in x) / either if either else 1.0)


def test_blocks_stay_small_whatever_the_ids(spark, prose):
    """One far id, and one id that a third of the rows have."""
    rows = [(i, prose(i, 20), "en", "s") for i in range(1_500)] + [(7, prose(-i, 20), "en", "s") for i in range(1, 800)] + [((1 << 63) - 1, "far", "en", "s"), (-(1 << 63), "far too", "en", "s"), (None, "none", "en", "s")]
    parts, seam = fingerprint.followed(frame(spark, rows).select("doc_id", "text"), 6_000)
    sizes = [r["count"] for r in parts.groupBy("block").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 250 and seam.count() == len(sizes)


def test_fingerprint_query_of_nothing_and_one(spark, tmp_path):
    for name, rows in (("none", []), ("one", [(1, "abc def", "en", "s")]), ("ties", [(1, "a", "en", "s"), (1, "a", "en", "s"), (None, "b", "en", "s"), (None, None, "en", "s")])):
        frame(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert fingerprint.op3_fingerprint(spark, f"{tmp_path}/{name}").count() == len(rows)


# Licenses -----------------------------------------------------------------------
def brute_licenses(text):
    """{license: best containment} over all windows, by sets of words alone."""
    import re

    def words(t):
        return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    mine, out = words(text), {}
    for name, texts in licenses.TEMPLATES.items():
        for template in texts:
            w = words(template)
            k = min(5, len(w))
            need = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
            step = next(s for s in sorted([2**i for i in range(12)] + [3 * 2**i for i in range(12)]) if 3 * s >= len(need))
            width = 4 * step if len(need) > 1 else 1
            have = [tuple(mine[i : i + k]) for i in range(len(mine) - k + 1)]
            for i in range(0, len(have), step):
                share = len(need.intersection(have[i : i + width])) / len(need)
                if share >= 0.8:
                    out[name] = max(share, out.get(name, 0))
    return out


def test_licenses_are_found_in_any_place(spark, prose):
    rows, want, n = [], {}, 0
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            for before in (0, 1, 3, 10, 57):
                rows.append((n, f"{prose(f'l{n}', before)} {text} {prose(f'r{n}', n % 40)}", "en", "s"))
                want[n] = name
                n += 1
    rows += [(1_000 + i, prose(i, 300), "en", "s") for i in range(20)] + [(2_000, None, "en", "s"), (2_001, "", "en", "s"), (2_002, "license", "en", "s"), (None, "Released under the MIT License.", "en", "s")]
    got = licenses.scan(frame(spark, rows, extra=True)).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, set()).add(r.license)
        assert 0.8 <= r.containment <= 1 and r.start_word < r.end_word
    assert all(want[i] in found.get(i, set()) for i in want)
    assert not any(i >= 1_000 for i in found if i is not None) and found[None] == {"MIT"}
    text = {i: t for i, t, *_ in rows}
    share = {(r.doc_id, r.license): r.containment for r in got}
    for i in [*range(n), 1_000, 1_001, 2_002]:
        want_here = brute_licenses(text[i])
        assert found.get(i, set()) == set(want_here) and all(share[i, name] == pytest.approx(v) for name, v in want_here.items())
    assert licenses.scan(frame(spark, [])).count() == 0


def test_altered_licenses_are_verified(spark):
    text = licenses.TEMPLATES["MIT"][2].split()
    text[25] = "altered"
    rows = [(1, " ".join(text), "en", "s"), (2, " ".join(text[:10]), "en", "s")]
    assert {(r.doc_id, r.license) for r in licenses.scan(frame(spark, rows)).collect()} == {(1, "MIT")}


def test_a_text_is_scanned_alike_beside_any_others(spark, prose):
    text = licenses.TEMPLATES["MIT"][2].split()
    altered = " ".join([*text[:20], "inserted", "words", *text[20:]])
    seen = set()
    for before in range(0, 40, 3):
        docs = frame(spark, [(1, prose(before, before), "en", "s"), (2, altered, "en", "s"), (3, prose("c", 90), "en", "s")]).coalesce(1)
        seen |= {tuple(r) for r in licenses.scan(docs).collect()}
    assert len(seen) == 1 and next(iter(seen))[:2] == (2, "MIT") and next(iter(seen))[2] == pytest.approx(brute_licenses(altered)["MIT"])


def test_long_texts_and_many_notices(spark, prose):
    rows = [(1, " ".join(f"{prose(i, 400)} Licensed under CC BY-NC 4.0." for i in range(60)), "en", "s")]
    r = licenses.scan(frame(spark, rows)).first()
    assert r.license == "CC-BY-NC-4.0" and r.n_windows >= 60


# Quality rules ----------------------------------------------------------------------
def brute_counts(text):
    text = text or ""
    space = " \t\n\x0b\x0c\r"
    words = text.encode().split()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.strip(space)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(c not in space for c in text), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_counts_equal_a_plain_reading(spark, corpus, prose):
    rows = [*corpus, (800, " ".join(["to"] * 60), "en", "s"), (801, f"{prose(1, 30)}\n{prose(1, 30)}\n{prose(1, 30)}\n\n \n", "en", "s"), (802, "a#b* $ %&|<>\x1c\xa0 x", "en", "s"), (803, "\n".join(["same line"] * 5 + ["same line "]), "en", "s")]
    got = quality_rules.judge(frame(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, *_ in rows}
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(text[r.doc_id])
            assert not (r.base_failed and r.kept)
    assert quality_rules.judge(frame(spark, [])).count() == 0


def brute_distance(p, q):
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    return np.sqrt(max(0, (kl(p) + kl(q)) / 2))


def test_distances_equal_a_plain_reading(spark, prose):
    rows = [(i, prose(i, 150, 300), "en", "s") for i in range(40)] + [(100, prose(100, 150, 300).upper(), "en", "s"), (101, " ".join(f"z{i}" for i in range(150)), "en", "s"), (102, prose(5, 30), "en", "s")]
    rules = quality_rules.Rules()
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, rows), rules).collect()}
    classes = quality_rules.char_classes([t for _, t, *_ in rows])
    hashed = [(batch([t])[0] >> np.uint64(64 - quality_rules.BUCKET_BITS)).astype(int) for _, t, *_ in rows]
    every = Counter(b for x in hashed for b in x)
    common = [b for b, _ in sorted(every.items(), key=lambda x: (-x[1], x[0]))[: rules.common_words]]
    q = np.array([every[b] for b in common] + [sum(every.values()) - sum(every[b] for b in common)], float)
    for (i, *_), c, x in zip(rows, classes, hashed, strict=True):
        mine = Counter(x)
        p = np.array([mine[b] for b in common] + [sum(n for b, n in mine.items() if b not in set(common))], float)
        assert got[i].word_distance == pytest.approx(brute_distance(p, q) if len(x) >= rules.word_guard else 0.0, abs=1e-9)
        assert got[i].char_distance == pytest.approx(brute_distance(c.astype(float), classes.sum(axis=0).astype(float)) if c.sum() >= rules.char_guard else 0.0, abs=1e-9)
    assert not got[101].kept and got[3].kept


# Classifier -----------------------------------------------------------------------------
def labelled(prose, n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = " ".join(f"{w}!!" for w in prose(i, 80).upper().split()) if bad else prose(i, 90)
        rows.append((i, text, "en" if i % 2 else "de", f"s{i % 5}"))
        if i % 3 == 0:
            labels.append((i, int(not bad), 0))
    return rows, labels


def test_cotraining_reaches_held_out_accuracy(spark, prose):
    rows, labels = labelled(prose)
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = cotraining.score(docs, known).collect()
    seen = {i for i, *_ in labels}
    right = [r.kept == (r.doc_id % 4 != 0) for r in got if r.doc_id not in seen]
    assert len(right) > 200 and np.mean(right) > 0.97
    again = {r.doc_id: r.p_quality for r in cotraining.score(docs.repartition(7), known).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.p_quality, abs=1e-3) for r in got)


def test_pseudo_labels_help_the_other_view():
    """Two views of which one knows: what it is sure of teaches the other one."""
    r = np.random.default_rng(1)
    y = np.tile([1, 0], 1_000)
    a = (y[:, None] * 4.0 + r.normal(size=(2_000, 3))).astype(np.float32)
    b = (y[:, None] * 0.5 + r.normal(size=(2_000, 40))).astype(np.float32)
    how = cotraining.Training()
    pool = [a[60:], b[60:]]
    right = []
    for rounds in (0, 3):
        model = cotraining.cotrain([a[:60], b[:60]], y[:60], lambda m: cotraining.lessons(m, pool, how), cotraining.Training(rounds=rounds))
        right.append([np.mean((o > 0) == (y[60:] == 1)) for o in model.log_odds(pool)])
    assert right[1][0] > 0.95 and right[1][1] > right[0][1] + 0.005


def brute_content(text):
    data = (text or "").encode()
    counts = np.zeros(cotraining.HASHED)
    for i in range(len(data)):
        a, b, c = (*data[i : i + 3], 0, 0)[:3] if i + 3 > len(data) else data[i : i + 3]
        counts[((a | b << 8 | c << 16) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - cotraining.HASHED.bit_length() + 1)] += 1
    x = np.log1p(counts)
    return x / max(np.linalg.norm(x), 1e-6)


def test_rounds_read_every_document_that_is_not_in_the_sample(spark, prose):
    """Sums, probabilities and verdicts against a document by document reading."""
    rows, labels = labelled(prose, 120)
    rows += [(500, None, None, None), (501, "", "en", "s0"), (None, prose(7, 60), "de", "s1"), (3, rows[3][1], "en", "s3")]
    docs, known = frame(spark, rows, extra=True).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    how = cotraining.Training(rounds=1)
    model = cotraining.train(docs, known, how)
    own = frozenset(i for i, *_ in labels)
    got = cotraining.taught(docs, model, own, how)
    want = [[0.0, 0.0], [0.0, 0.0]]
    scored = {}
    for i, text, lang, source in rows:
        views = [brute_content(text), cotraining.page([text], [lang], [source])[0].astype(float)]
        raw = [float((x - v.mean) / v.scale @ v.weights + v.bias) for v, x in zip(model.views, views, strict=True)]
        odds = [min(12, max(-12, v.slope * s + v.offset)) for v, s in zip(model.views, raw, strict=True)]
        scored[i] = [1 / (1 + np.exp(-z)) for z in (odds[0], odds[1], odds[0] + odds[1] - model.prior)]
        if i in own:
            continue
        for student in (0, 1):
            p = scored[i][1 - student]
            if p >= how.confidence or p <= 1 - how.confidence:
                label = int(p > 0.5)
                r = 1 / (1 + np.exp(-raw[student])) - label
                want[student][label] = want[student][label] + np.concatenate([r * views[student], [r, 1]])
    for student in (0, 1):
        for label in (0, 1):
            assert np.allclose(got[student][label], want[student][label], atol=5e-3)
    assert sum(got[0][c][-1] for c in (0, 1)) > 60
    for r in cotraining.score(docs, known, how).collect():
        assert [r.p_content, r.p_page, r.p_quality] == pytest.approx(scored[r.doc_id], abs=1e-3) and r.kept == (r.p_quality >= 0.5)


def test_the_sample_is_the_same_under_any_partitioning(spark, prose):
    rows = [(i % 50, prose(i, 30), "en", f"s{i}") for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    taken = []
    for parts in (1, 3, 11):
        views, y, own = cotraining.sample(frame(spark, rows).repartition(parts), labels, cotraining.Training())
        assert len(y) == 50 and len(own) == 50
        taken.append([v.tobytes() for v in views] + [y.tobytes()])
    assert taken[0] == taken[1] == taken[2]


def test_names_are_read_whole():
    long = "n" * 60
    a, b = cotraining.page(["x", "x"], ["en", "en"], [f"{long}1", f"{long}2"])
    assert (a != b).any()


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, None, 0), (None, 1, 0), (2, 7, 0)], [(99_999, 0, 0)]])
def test_without_labels_of_both_kinds_all_is_kept(spark, corpus, labels):
    got = cotraining.score(frame(spark, corpus, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(corpus) and all(r.kept for r in got)


def test_accepted_keeps_columns(spark, prose):
    rows, labels = labelled(prose, 200)
    rows += [(1_000, None, None, None), (1_001, "", "en", "s"), (None, prose(3, 90), "en", "s1"), (5, rows[5][1], "de", "s0")]
    docs = frame(spark, rows, extra=True)
    out = cotraining.accepted(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and kept.count(5) == 2 and 4 not in kept and None in kept
    assert cotraining.accepted(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
