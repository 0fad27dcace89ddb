from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from gneiss.llm import jaccard, substring
from gneiss.llm.components import components
from gneiss.llm.jaccard import Likeness
from gneiss.llm.substring import Windows

from .conftest import frame


def words_of(text):
    return (text or "").encode().split()


def brute_components(rows, k, num, den):
    """doc_id -> (number of shingles, least doc_id reachable), by comparing all pairs."""
    sets, ids = {}, [i for i, *_ in rows if i is not None]
    for i, text, *_ in rows:
        w = [x.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for x in words_of(text)]
        if i is not None:
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in sets:
        for y in sets:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if den * both >= num * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((find(x), find(y)))
                    root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("how", [Likeness(3, 90, 100), Likeness(5, 80, 100), Likeness(2, 50, 100)])
def test_join_equals_all_pairs(spark, corpus, how):
    want = brute_components(corpus, how.shingle, how.num, how.den)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, corpus), how).collect()]
    assert len(got) == len(corpus)
    assert {(i, n, c) for i, n, c in got if i is not None} == {(i, *v) for i, v in want.items()}


def test_join_of_near_copies_that_link_in_chains(spark, prose):
    """A hundred texts, each an edit of another one: links run through many hops, most pairs are not linked."""
    base = prose("base", 120).split()
    rows, texts, r = [], [base], np.random.default_rng(5)
    for i in range(100):
        w = list(texts[r.integers(len(texts))])
        for _ in range(r.integers(1, 4)):
            w[r.integers(len(w))] = f"n{i}x{r.integers(1000)}"
        texts.append(w)
        rows.append((i, " ".join(w), "en", "s"))
    for how in (Likeness(3, 90, 100), Likeness(5, 80, 100)):
        want = brute_components(rows, how.shingle, how.num, how.den)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows), how).collect()} == want


def test_join_of_nothing_and_of_clashing_columns(spark, corpus):
    assert jaccard.join(frame(spark, [])).count() == 0
    assert jaccard.join(frame(spark, [(1, None, "en", "s"), (2, "", "en", "s")])).count() == 2
    a, b = ({(r.doc_id, r.component_id) for r in jaccard.join(frame(spark, corpus, e)).collect()} for e in (False, True))
    assert a == b


def test_first_of_each_keeps_columns(spark, corpus):
    docs = frame(spark, corpus, extra=True)
    out = jaccard.first_of_each(docs)
    want = {i for i, (_, c) in brute_components(corpus, 5, 80, 100).items() if i == c}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect() if r.doc_id is not None} == want
    assert out.where("doc_id is null").count() == 2


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removed(rows, window):
    least = defaultdict(lambda: None)
    every = [(i, words_of(t)) for i, t, *_ in rows if i is not None]
    for i, w in every:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            least[k] = i if least[k] is None else min(least[k], i)
    out = {}
    for i, w in every:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if least[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


@pytest.mark.parametrize("how", [Windows(), Windows(12, 4), Windows(20, 20)])
def test_parse_removes_what_windows_share(spark, corpus, prose, how):
    again = prose("twice", 80)
    rows = [*corpus, (600, f"{again} x {again}", "en", "s"), (601, f"start {again} {prose('mid', 30)} {again}", "en", "s"), (602, " ".join(["same"] * 200), "en", "s"), (603, " ".join(["same"] * 120), "en", "s")]
    want = brute_removed(rows, how.window)
    got = substring.parse(frame(spark, rows), how).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]


def test_factors_copy_the_words_of_their_references(spark, corpus):
    text = {i: words_of(t) for i, t, *_ in corpus}
    got = substring.parse(frame(spark, corpus), Windows(12, 4)).collect()
    n = 0
    for r in got:
        at = 0
        for f in r.factors or []:
            assert f.start >= at and f.ref_doc < r.doc_id
            assert text[r.doc_id][f.start : f.start + f.length] == text[f.ref_doc][f.ref_start : f.ref_start + f.length]
            at, n = f.start + f.length, n + 1
    assert n > 10


def test_parse_of_nothing_and_of_clashing_columns(spark, corpus):
    assert substring.parse(frame(spark, [])).count() == 0
    a, b = ({(r.doc_id, hashlib.md5(r.kept.encode()).hexdigest()) for r in substring.parse(frame(spark, corpus, e)).collect()} for e in (False, True))
    assert a == b


def test_greedy_factors_take_the_furthest_match():
    got = substring.factors([(0, 50, 1, 0), (1, 51, 1, 1), (30, 90, 2, 5), (40, 60, 3, 0), (100, 150, 1, 200)])
    assert [(f["start"], f["length"], f["ref_doc"], f["ref_start"]) for f in got] == [(0, 51, 1, 0), (51, 39, 2, 26), (100, 50, 1, 200)]
