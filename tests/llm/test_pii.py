from __future__ import annotations

import hashlib
import math
import random
import re

import pytest

from gneiss.llm import pii

from .conftest import frame

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_spans_equal_the_plain_patterns():
    r = random.Random(1)
    alphabet = ["1", "2", "25", "4", "0", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "%", "é", "\n", "4111111111111111", "a@b.de", "+1 (555) 010-9999", "10.0.0.1"]
    for _ in range(4_000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
        assert pii.base_spans(text) == brute(text), text


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000, "a" * 100_000 + "@", "@" * 200_000, "+1 " * 60_000, "1.1." * 50_000, "a@b." * 40_000])
def test_long_runs_are_read_in_one_pass(text):
    pii.base_spans(text)


def test_documents_with_all_kinds_of_rows(spark, corpus):
    rows = [*corpus, (500, "mail a.b@example.com, ip 10.1.2.3, card 4111 1111 1111 1111, call +1 (555) 010-9999", "en", "s0"), (501, "é" * 3 + " x@y.zz", "en", "s0")]
    plain, extra = ({(r.doc_id, str(r.base), str(r.added)) for r in pii.find(frame(spark, rows, e)).collect()} for e in (False, True))
    assert plain == extra
    got = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect() if r.doc_id is not None}
    for i, text, *_ in rows:
        if i is not None:
            assert [tuple(x) for x in got[i].base] == brute(text)
    assert len(pii.find(frame(spark, rows)).collect()) == len(rows)
    assert pii.find(frame(spark, [])).count() == 0


def test_terms_that_disclose_an_entity_are_found_and_copies_do_not_make_them(spark, prose):
    rows = [(i, prose(i, 60), "en", "s") for i in range(300)]
    # "quixotia" stands near one address only, in different contexts: it gives it away. "common" stands everywhere.
    rows += [(1_000 + i, f"{prose(f'x{i}', 30)} common Quixotia writes from hero@example.com {prose(f'y{i}', 30)}", "en", "s") for i in range(6)]
    rows += [(2_000 + i, f"{prose(f'z{i}', 30)} common word here", "en", "s") for i in range(60)]
    # Ten copies of one document: its rare words stand near its address in one context only.
    rows += [(3_000 + i, "singular plectrum beside lone@example.com and nothing else", "en", "s") for i in range(10)]
    found = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    text = {i: t for i, t, *_ in rows}
    added = {(text[d][x.start : x.end].lower(), x.kind) for d, r in found.items() for x in r.added}
    n, both = len(rows), 6
    assert math.log(both * n / (both * both)) / math.log(n / both) >= 0.9
    assert ("quixotia", 4) in added and not any(w.startswith(("common", "singular", "plectrum", "beside")) for w, _ in added)
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert "hero@" not in clean[1_000] and "Quixotia" not in clean[1_000] and "<EMAIL>" in clean[1_000] and "common" in clean[1_000]
    assert all(clean[i] == text[i] for i in range(300))


def test_values_in_two_documents_are_evidence_and_values_in_one_are_not(spark, prose):
    rows = [(i, prose(i, 60), "en", "s") for i in range(300)]
    rows += [(1_000 + i, f"{prose(f'x{i}', 20)} Quixotia writes from twice@example.com {prose(f'y{i}', 20)}", "en", "s") for i in range(2)]
    rows += [(2_000, f"{prose('u', 20)} Dulcinea answers to once@example.com {prose('v', 20)}", "en", "s")]
    # Copies add nothing, to either side.
    rows += [(3_000 + i, rows[300 + i // 3][1], "en", "s") for i in range(6)]
    text = {i: t for i, t, *_ in rows}
    added = {(d, text[d][x.start : x.end]) for d, r in ((r.doc_id, r) for r in pii.find(frame(spark, rows)).collect()) for x in r.added}
    assert {(d, "Quixotia") for d in (1_000, 1_001, *range(3_000, 3_006))} <= added
    assert not any(d == 2_000 for d, _ in added)
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert all("Quixotia" not in clean[d] for d in (1_000, 1_001, 3_000, 3_005)) and "Dulcinea" in clean[2_000]


def test_terms_are_counted_and_marked_anywhere_in_the_documents_of_an_entity(spark, prose):
    rows = [(i, prose(i, 60), "en", "s") for i in range(300)]
    # "Quixotia" stands beside the address once; otherwise, and "Rocinante" always, further off than the context reaches.
    rows += [(1_000 + i, f"Rocinante {prose(f'a{i}', 60)} Quixotia {prose(f'b{i}', 60)} Quixotia at hero@example.com {prose(f'c{i}', 60)} quixotia", "en", "s") for i in range(4)]
    # A document with nothing near its address counts as one that holds it.
    rows += [(2_000 + i, f"{'- ' * 100}bare@example.com{' -' * 100} Dulcinea {prose(f'd{i}', 30)}", "en", "s") for i in range(3)]
    found = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    for d, text, *_ in rows[300:]:
        want = [(m.start(), m.end()) for m in re.finditer("rocinante|quixotia|dulcinea", text, re.IGNORECASE)]
        assert set(want) <= {(x.start, x.end) for x in found[d].added}
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert not any(w in clean[d].lower() for d, *_ in rows[300:] for w in ("rocinante", "quixotia", "dulcinea"))


def brute_added(texts, how=pii.Disclosure()):
    """Spans by disclosure of each text, counted from the definitions with sets."""
    term = re.compile("[A-Za-z\u0080-\U0010ffff]{%d,}" % how.least_letters)
    run = re.compile("[A-Za-z\u0080-\U0010ffff]+")
    fold = {c: c + 32 for c in range(65, 91)}
    facts, contexts, both = [], {}, {}
    for text in texts:
        spans = brute(text)
        words = [(m.start(), m.end(), m[0].translate(fold)) for m in run.finditer(text or "") if term.fullmatch(m[0])]
        free = [w for w in words if not any(s < w[1] and w[0] < e for s, _, e in spans)]
        held = {}
        for s, k, e in spans:
            value = (k, text[s:e].lower() if k < 2 else re.sub("[^0-9]", "", text[s:e]))
            near = tuple(t for a, b, t in free if s - how.reach <= a < e + how.reach and b <= e + how.reach)
            held.setdefault(value, near or text)
        facts.append((held, free, {t for *_, t in words}))
        for value, context in held.items():
            contexts.setdefault(value, set()).add(context)
            for t in {t for *_, t in free}:
                docs, seen = both.setdefault((value, t), [[], set()])
                docs.append(text)
                seen.add(context)
    n_term = {}
    for *_, words in facts:
        for t in words:
            n_term[t] = n_term.get(t, 0) + 1
    kind = {}
    for (value, t), (docs, seen) in both.items():
        rate = len(contexts[value]) / len(texts)
        if len(contexts[value]) > 1 and len(seen) > 1 and rate < 1:
            share = math.log((len(seen) - 1 + rate) / (n_term[t] - len(docs) + len(seen)) / rate) / -math.log(rate)
            if share >= how.generalise:
                kind[value, t] = 4 if share >= how.remove else 5
    return [sorted({(s, e, min(kind[v, t] for v in held if (v, t) in kind)) for s, e, t in free if any((v, t) in kind for v in held)}) for held, free, _ in facts]


def test_disclosure_equals_a_count_by_definition(spark, prose):
    r = random.Random(4)
    names = ["Quixotia", "Dulcinea", "Rocinante", "Ümlaut", "Sancho", "Panza", "Toboso"]
    values = ["hero@example.com", "10.1.2.3", "+1 (555) 010-9999", "4111 1111 1111 1111"]
    rows = [(i, re.sub("w[0-9a-f]", lambda m: r.choice("abcdefgh") * 3, prose(i, 40)), "en", "s") for i in range(150)]
    for i in range(60):
        near = " ".join(r.sample(names, 3))
        rows.append((1_000 + i % 50, f"{rows[i][1]} {near} {r.choice(values)} {'x ' * r.randrange(90)} {r.choice(names)} {r.choice(values)}", "en", "s"))
    rows += [(None, rows[160][1] + " Sancho", "en", "s"), (None, rows[161][1] + " Panza Toboso", "en", "s"), (5_000, None, "en", "s"), *rows[170:180]]
    rows += [(6_000 + i, f"{rows[i][1]} Barataria solo@example.com {rows[i + 9][1]}", "en", "s") for i in range(8)]
    want = {}
    for (i, text, *_), spans in zip(rows, brute_added([t for _, t, *_ in rows]), strict=True):
        want[i, text or ""] = spans
    text_of = {r.text_key: r.text for r in frame(spark, rows).selectExpr("xxhash64(text) as text_key", "coalesce(text, '') as text").collect()}
    got = pii.find(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sum(map(len, want.values())) > 60
    for x in got:
        assert [(s.start, s.end, s.kind) for s in x.added] == want[x.doc_id, text_of[x.text_key]]
    kinds = {k for spans in want.values() for *_, k in spans}
    assert kinds == {4, 5}
    clean = [x.text for x in pii.sanitise(frame(spark, rows)).collect()]
    assert sorted(t or "" for t in clean) == sorted(pii.rewrite(t, pii.base_spans(t) + [(s, k, e) for s, e, k in want[i, t or ""]]) or "" for i, t, *_ in rows)


def test_sanitise_keeps_columns_and_rows(spark, corpus):
    docs = frame(spark, corpus, extra=True)
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == len(corpus)


def test_query_digests(spark, tmp_path):
    rows = [(1, "a@b.cc and 1.2.3.4", "en", "s"), (2, None, "en", "s")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op1_pii(spark, str(tmp_path)).collect()}
    assert got[1].spans == "email:0:6,ip:11:18" and got[1].base_sha256 == hashlib.sha256(b"email:0:6,ip:11:18").hexdigest()
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 0, 0)
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
