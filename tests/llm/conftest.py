from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", block string, place int, class string, n int, head string, token string, component string, added string, spans string, mixed string, y string, kept string"


def frame(spark, rows, extra=False):
    """Documents from (doc_id, text, lang, source); with columns whose names clash with inner ones if asked for."""
    full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    if extra:
        return spark.createDataFrame([(*r, "x", 1, "x", 1, "x", "x", "x", "x", "x", "x", "x", "x") for r in full], SCHEMA + EXTRA)
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def prose():
    """A function of a seed: n invented words."""

    def words(seed, n, vocabulary=4_000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary):x}" for _ in range(n))

    return words


@pytest.fixture(scope="session")
def corpus(prose):
    """Copies, near copies, shared passages, long, short, empty and null texts; null ids, languages and sources."""
    passage = prose("passage", 70)
    rows = [(i, prose(i, 40 + i % 60), "en" if i % 3 else "de", f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(8)]
    for i in range(10):
        w = rows[20 + i][1].split()
        w[len(w) // 2] = f"edit{i}"
        rows.append((200 + i, " ".join(w), "en", "s1"))
    rows += [(300 + i, f"{prose(f'a{i}', 20)} {passage}\n{prose(f'b{i}', 5 * i)}", "en", "s2") for i in range(8)]
    rows += [(400, prose("long", 6_000), "en", "s3"), (401, "", "en", "s0"), (402, None, "en", "s0"), (403, None, None, None), (404, "one", "fr", None), (405, "ONE", None, "s1"), (406, "two words", "en", "s1"), (407, " \t\n ", "en", "s1"), (408, "é ü ß 😀 x", "de", "s2")]
    rows += [(None, prose("none", 60), "en", "s0"), (None, None, "en", "s0"), (59, rows[59][1], rows[59][2], rows[59][3])]
    return rows
