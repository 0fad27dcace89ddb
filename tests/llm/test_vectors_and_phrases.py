"""Whitening, fingerprints near each other and collocations, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from gneiss.llm import collocations, simhash, whitening
from gneiss.llm.collocations import Mining
from gneiss.llm.simhash import COARSE, GOLAY, HAMMING, Anchors, Nearness, repetition

from .conftest import frame

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, x int, component string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", "x") for i, v in rows], VECTORS)


def whitened(rows, components):
    """(n, vec_id -> exact deviation, vec_id -> whitened, explained) by whole numbers and one covariance."""
    x = {i: [int(np.floor(64 * c)) + 1_000_000 for c in v] for i, v in rows}
    distinct = sorted(set(map(tuple, x.values())))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in x.items()}
    c = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in distinct])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    mine = {i: np.array([(n * a - s) / n for a, s in zip(v, sums, strict=True)]) @ u[:, :components] / np.sqrt(e[:components]) for i, v in x.items()}
    return n, deviation, mine, e[:components] / e.sum()


def compare(got, rows, components):
    n, deviation, mine, explained = whitened(rows, components)
    assert len(got) == len(rows) * components
    signs = {}
    for r in got:
        want = mine[r.vec_id][r.component - 1]
        assert r.n == n and r.deviation == deviation[r.vec_id] and abs(r.explained / explained[r.component - 1] - 1) < 1e-6
        assert abs(abs(r.whitened) - abs(want)) < 1e-6 and r.identity_error < 1e-6
        if abs(want) > 1e-3:
            assert signs.setdefault(r.component, np.sign(want) == np.sign(r.whitened)) == (np.sign(want) == np.sign(r.whitened))


@pytest.mark.parametrize(("length", "components"), [(5, 3), (20, 16), (3, 16)])
def test_whitening_equals_one_covariance(spark, length, components):
    r = np.random.default_rng(length)
    rows = [(i, (r.normal(size=length) * np.arange(1, length + 1) + 50).tolist()) for i in range(200)]
    rows += [(200 + i, rows[i % 7][1]) for i in range(100)]
    odd = [(900, None), (901, [None] * length), (902, [float("nan")] * length), (903, [float("inf")] + [0.0] * (length - 1)), (904, [1.0] * (length + 1)), (905, []), (906, [1e300] * length)]
    got = whitening.whiten(vectors(spark, [*rows, *odd]).repartition(7), components=components).collect()
    compare(got, rows, min(components, length))


def test_whitening_of_the_query_equals_one_covariance(spark):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    compare(whitening.op11_whitening(spark, FOLDER).collect(), rows, 16)


def test_whitening_of_large_numbers_is_exact(spark):
    rows = [(i, [float(2**40 * (i % 5) + i), -float(2**38 * i)]) for i in range(30)]
    n, deviation, *_ = whitened(rows, 2)
    got = {r.vec_id: r.deviation for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert got == {i: d if d < 1 << 63 else None for i, d in deviation.items()} and None in got.values()


def test_whitening_without_vectors_or_variance(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).columns == [c.split()[0] for c in whitening.DDL.split(", ")]
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(got) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.n == 1 and r.deviation == 0 for r in got)
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i]) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and max(r.identity_error for r in line) < 1e-9


def naive_fingerprint(text, shingle=4):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(rows, bits):
    """(doc_id -> least doc_id reachable) by comparing all pairs of fingerprints."""
    prints = {i: f for i, f in rows if i is not None}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in prints:
        for y in prints:
            if x < y and (prints[x] ^ prints[y]).bit_count() <= bits:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: find(i) for i in prints}


@pytest.mark.parametrize("code", [GOLAY, HAMMING, repetition(9), repetition(3)])
def test_codes_are_perfect(code):
    """Within the covering radius of every syndrome's words lies exactly one code word."""
    patterns, beyond, begin = code.errors(2)
    assert [int((beyond[a:b] == 0).sum()) for a, b in zip(begin[:-1], begin[1:], strict=True)] == [1] * (1 << code.parity)
    assert not code.remainder(code.remainder(np.arange(1 << min(12, code.length), dtype=np.uint64)) ^ np.arange(1 << min(12, code.length), dtype=np.uint64)).any()


@pytest.mark.parametrize("how", [Nearness(), Nearness(codes=COARSE), Nearness(bits=3), Nearness(bits=1, codes=(GOLAY, HAMMING)), Nearness(codes=(repetition(21), repetition(21), repetition(21)))])
def test_near_strings_share_an_anchor(how):
    r = np.random.default_rng(how.bits)
    x = r.integers(0, 1 << 64, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in r.choice(64, i % (how.bits + 1), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    around = Anchors(how.codes, how.margin)
    (i, a), (j, b) = around.of(x), around.of(y)
    assert {p for p, _ in set(zip(i.tolist(), a.tolist(), strict=True)) & set(zip(j.tolist(), b.tolist(), strict=True))} == set(range(len(x)))
    assert len(set(zip(i.tolist(), a.tolist(), strict=True))) == len(i)


def test_near_equals_all_pairs(spark, corpus, prose):
    rows = list(corpus)
    for i in range(60):
        w = prose("base", 300).split()
        for j in range(i % 5):
            w[(7 * i + j * 31) % 300] = f"e{i}x{j}"
        rows.append((1_000 + i, " ".join(w), "en", "s"))
    rows += [(2_000, "A b C", "en", "s"), (2_001, "a\tB  c", "en", "s"), (2_002, "a b c d", "en", "s"), (2_003, "a b c d a b c d a", "en", "s")]
    for extra in (False, True):
        got = simhash.near(frame(spark, rows, extra)).collect()
        assert len(got) == len(rows)
        prints = {(i, naive_fingerprint(t)) for i, t, *_ in rows}
        assert {(r.doc_id, int(r.fingerprint, 16)) for r in got} == prints and all(len(r.fingerprint) == 16 for r in got)
        want = naive_components(prints, 4)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert all(r.component_id is None for r in got if r.doc_id is None)
    assert len(set(want.values())) < len(want) - 40


@pytest.mark.parametrize("how", [Nearness(), Nearness(codes=COARSE), Nearness(bits=7)])
def test_linked_in_chains_and_clouds(spark, how):
    """Paths of small steps, and a cloud round one fingerprint in which most pairs are too far apart."""
    r = random.Random(how.bits)
    prints = []
    for start in range(4):
        at = r.getrandbits(64)
        for _ in range(40):
            prints.append(at)
            for b in r.sample(range(64), r.choice([1, 3, how.bits, how.bits + 1])):
                at ^= 1 << b
    middle = r.getrandbits(64)
    for _ in range(150):
        f = middle
        for b in r.sample(range(64), r.randrange(how.bits + 4)):
            f ^= 1 << b
        prints.append(f)
    rows = list(enumerate(prints))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, c) for f, c in Counter(prints).items()], "bits long, docs long")
    lead = {r.id & (1 << 64) - 1: r.component for r in simhash.linked(nodes, how).collect()}
    want, groups = naive_components(rows, how.bits), {}
    for i, f in rows:
        groups.setdefault(want[i], set()).add(lead.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_links_of_small_anchors_connect_as_all_pairs(spark, monkeypatch):
    """Links grow with the rows; anchors beyond ``MEMBERS`` go the other way, with the same components."""
    r = random.Random(11)
    middle = r.getrandbits(64)
    prints = sorted({middle ^ sum(1 << b for b in r.sample(range(64), r.randrange(9))) for _ in range(400)})
    label = simhash.reached(np.array(prints, np.uint64), 4)
    least = {i: min(j for j, x in enumerate(label) if x == label[i]) for i in range(len(prints))}
    want = naive_components(list(enumerate(prints)), 4)
    assert least == want and (label <= np.arange(len(label))).all()
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    lists = spark.createDataFrame([(a, f) for a in range(3) for f in signed], "anchor long, bits long").coalesce(1).sortWithinPartitions("anchor")
    assert 0 < simhash.within(lists, Nearness()).count() <= 3 * len(prints)
    nodes = spark.createDataFrame([(f, 1) for f in signed], "bits long, docs long")
    found = []
    for members in (4_096, 20, 1):
        monkeypatch.setattr(simhash, "MEMBERS", members)
        found.append({r.id: r.component for r in simhash.linked(nodes, Nearness()).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_near_of_nothing(spark):
    assert simhash.near(frame(spark, [])).count() == 0
    got = simhash.near(frame(spark, [(5, None, None, None), (3, "", "en", "s"), (4, " \n", "en", "s")])).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, "0" * 16, 3) for i in (3, 4, 5)}


def naive_phrases(rows, how):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, how.words + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= how.least}
    found = {}
    for p, a in candidates.items():
        inside = [b for q, b in candidates.items() if q[0] == p[0] and len(q) > len(p) and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q) - len(p) + 2))]
        if any(100 * b >= how.share * a for b in inside):
            continue
        score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[(p[0], *p[k:])]), k, f[p[:k]], f[(p[0], *p[k:])]) for k in range(2, len(p)))
        found.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, ps in found.items() for i, (s, a, p, left, right) in enumerate(sorted(ps)[: how.first], 1)}


@pytest.mark.parametrize("how", [Mining(least=5), Mining(least=3, share=60, first=25), Mining(words=2, least=4), Mining(words=3, least=2)])
def test_phrases_equal_counting_all(spark, prose, corpus, how):
    r = random.Random(7)
    sets = ["new york city", "San Francisco bay area", "of the", "état d'esprit", "x", "a b", "\x00 .odd\x0b"]
    rows = [(i, " ".join(r.choice(sets) + r.choice([" ", "\t", ", ", ".", "\n", "!? "]) + prose(i * 50 + j, 2, 12) for j in range(20)), r.choice(["en", "de", None, "und", ""]), "s") for i in range(80)]
    rows += [(500, " ".join(["same"] * 50), "en", "s"), *corpus]
    got = [tuple(x) for x in collocations.mine(frame(spark, rows).repartition(5), how).collect()]
    assert len(got) == len(set(got)) and set(got) == naive_phrases(rows, how)


def test_phrases_do_not_depend_on_the_filter(spark, prose):
    """With a small filter more is counted, with the same results."""
    rows = [(i, prose(i % 5, 60, 30), "en", "s") for i in range(40)]
    want = naive_phrases(rows, Mining(least=8))
    for bits in (19, 22):
        assert {tuple(x) for x in collocations.mine(frame(spark, rows), Mining(least=8, filter_bits=bits)).collect()} == want
    assert want


def test_phrase_scores_pass_64_bits(spark):
    big = 3 * 10**18
    tables = [spark.createDataFrame([("en", "a", big), ("en", "b", big + 1), ("en", None, big)], "lang string, phrase string, f long"), spark.createDataFrame([("en", "a b", big - 7)], "lang string, phrase string, f long")]
    r = collocations.scored(tables, Mining()).collect()
    assert [(x.a, x.l, x.r, x.score) for x in r] == [(big - 7, big, big + 1, 2_000_000 * (big - 7) // (2 * big + 1))]


def test_phrases_of_nothing_and_of_clashing_columns(spark, prose):
    assert collocations.mine(frame(spark, [])).count() == 0
    assert collocations.mine(frame(spark, [(1, None, None, None), (2, "", "en", "s"), (3, "...", "en", "s")])).count() == 0
    rows = [(i, prose(1, 30, 40), "en", "s") for i in range(9)]
    a, b = ({tuple(x) for x in collocations.mine(frame(spark, rows, e), Mining(least=9)).collect()} for e in (False, True))
    assert a == b and a


def test_phrases_of_the_query_equal_its_sql(spark):
    duck = duckdb.connect()
    folder = FOLDER.replace("0.001", "0.01")
    duck.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    want = duck.sql(f"select lang, rank, phrase, a, l, r, n, score from ({collocations.OP13_SQL})").fetchall()
    assert sorted(map(tuple, collocations.op13_collocations(spark, folder).collect())) == sorted(want) and len(want) > 100
