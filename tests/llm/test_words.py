"""Hashes of words and ranges: distinct where a polynomial modulo 2**64 is not."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gneiss.llm import jaccard, quality_rules, substring, words
from gneiss.llm.jaccard import Likeness
from gneiss.llm.tokens import Encoder

from .conftest import frame
from .test_duplicates import brute_components, brute_removed


def thue_morse(n, a="a", b="b", between=""):
    """The sequence and its mirror image: equal sums of powers of any odd number modulo 2**64 from 2**10 terms on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return between.join(b if x else a for x in bits), between.join(a if x else b for x in bits)


PAIRS = [thue_morse(1_024), thue_morse(2_048, "x", "é"), thue_morse(64), thue_morse(8)]


def test_products_modulo_the_prime():
    r, p = np.random.default_rng(1), int(words.PRIME)
    a, b = (np.concatenate([[0, 1, p - 1], r.integers(0, p, 500)]).astype(np.uint64) for _ in range(2))
    assert words.times(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b, strict=True)]
    assert words.powers(12_345, 40)[:40].tolist() == [pow(12_345, i, p) for i in range(40)]


@pytest.mark.parametrize("pair", PAIRS)
def test_distinct_words_have_distinct_hashes(pair):
    many = [*pair, *(p[:n] for p in pair for n in (7, 8, 9, 16, 17, 63, 64, 65) if n < len(p))]
    h, _ = words.batch(many)
    assert len(set(h.tolist())) == len(set(many))
    alone = [words.batch([t])[0][0] for t in many]
    assert alone == h.tolist()


def test_ranges_tell_mirrored_sequences_apart_and_know_equal_ones():
    for n in (64, 1_024, 4_096):
        h, bounds = words.batch([*thue_morse(n, between=" "), thue_morse(n, between=" ")[0]])
        of = words.Ranges(h).of(bounds[:-1], bounds[1:])
        assert of[0] != of[1] and of[0] == of[2]
    h, _ = words.batch(["a b c x a b c"])
    of = words.Ranges(h).of(np.array([0, 4, 1]), np.array([3, 7, 3]))
    assert of[0] == of[1] != of[2]


def mirrored(prose):
    """Texts whose words differ in one long word only."""
    rows = []
    for i, pair in enumerate(PAIRS):
        for j, word in enumerate((*pair, pair[0])):
            w = prose(f"mirror{i}", 60).split()
            w[49] = word
            rows.append((10 * i + j, " ".join(w), "en", "s"))
    return rows


def test_operators_tell_mirrored_words_apart(spark, prose):
    rows = mirrored(prose)
    want = brute_removed(rows, 50)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.parse(frame(spark, rows)).collect()} == want
    for how in (Likeness(3, 98, 100), Likeness(5, 99, 100)):
        want = brute_components(rows, how.shingle, how.num, how.den)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows), how).collect()} == want
    a, b = PAIRS[0]
    w, bounds = words.batch([f"{' '.join('pqrstuv')} {x} {' '.join('pqrstuv')} {y}" for x, y in ((a, b), (a, a))])
    assert quality_rules.repeated_words(w, bounds, 8).tolist() == [0, 16]


def test_encoder_tells_mirrored_words_apart():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, mine = Tokenizer.from_file(path), Encoder(path)
    texts = [f"the {x} of" for pair in PAIRS for x in pair] * 2
    for batch in (texts, texts[:1], texts[1:2], texts[::-1]):
        assert [x.tolist() for x in mine(batch)] == [plain.encode(t, add_special_tokens=False).ids for t in batch]
