"""Quality rules: counts, and the divergence of a document from its language.

Two histograms of a document are held against references of its language: the
classes of its characters, and its most common words. References come from all
documents of the language. Word counts are kept in a fixed number of hash
buckets, so what a task holds does not grow with the vocabulary; the heaviest
buckets are the language's common words. The distance is the square root of the
Jensen-Shannon divergence in bits (0: alike, 1: nothing in common).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .jobs import arrow_schema, map_batches, map_rows, pieces, table
from .words import Ranges, batch, starts

CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "quote", "letter", "other")
SPACE, SYMBOL = CLASSES.index("space"), CLASSES.index("symbol")
BUCKET_BITS = 14


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict. Distances count only for texts of the least length."""

    least_words: int = 20
    most_repeated: int = 30  # per cent of the words in repeated windows
    window: int = 8
    common_words: int = 100
    char_distance: float = 0.30
    char_guard: int = 200  # code points
    word_distance: float = 0.42
    word_guard: int = 100  # words
    reference_words: int = 2_000  # a language with fewer has no word reference
    reference_chars: int = 10_000


@dataclass
class Reference:
    """What a language looks like: class counts, common buckets and their counts, all words."""

    chars: np.ndarray = field(default_factory=lambda: np.zeros(len(CLASSES)))
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    words: float = 0.0


@cache
def class_table() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, CLASSES.index("other"), np.uint8)
    out[128:] = [CLASSES.index("letter") if chr(c).isalpha() else CLASSES.index("other") for c in range(128, 0x110000)]
    for name, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", " \t\n\x0b\x0c\r"), ("stop", ".,;:!?"), ("symbol", "#*$%&|<>"), ("quote", "'\"()-")):
        out[[ord(c) for c in chars]] = CLASSES.index(name)
    return out


def char_classes(texts: list[str | None]) -> np.ndarray:
    """Counts of each class, a row a text."""
    lengths = [len(t or "") for t in texts]
    codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)) * len(CLASSES), lengths)
    return np.bincount(owner + class_table()[codes], minlength=len(texts) * len(CLASSES)).reshape(len(texts), len(CLASSES))


def duplicate_lines(text: str | None) -> int:
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def repeated_words(words: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Of each text, the words that lie in a window found twice or more in it."""
    at = starts(bounds, window)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(at):
        owner = np.searchsorted(bounds, at, side="right").astype(np.uint64)
        keys = Ranges(words).of(at, at + window) + owner * np.uint64(0xD1B54A32D192ED03)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + window, -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return total[bounds[1:]] - total[bounds[:-1]]


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts p to the counts q; 0 for a row without counts."""
    total = p.sum(axis=1, keepdims=True)
    p = np.divide(p, total, out=np.zeros(p.shape), where=total > 0)
    q = q / max(q.sum(), 1e-300)
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        ratio = np.divide(x, m, out=np.ones(m.shape), where=(m > 0) & (x > 0))
        return (x * np.log2(ratio)).sum(axis=1)

    out = np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1))
    return np.where(total[:, 0] > 0, out, 0.0)


def references(docs: DataFrame, rules: Rules = Rules()) -> dict[str, Reference]:
    """The reference of each language (null: its own), from all documents.

    A task adds up its rows and emits a row for each bucket that it met; sums
    are combined before the shuffle. A few hundred rows a language reach the
    driver.
    """
    ddl = "lang string, kind int, bucket int, n long"
    schema = arrow_schema(ddl)

    def emit(held: dict) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], []]
        for (lang, kind), n in held.items():
            at = np.flatnonzero(n)
            for col, values in zip(cols, ([lang] * len(at), [kind] * len(at), at.tolist(), n[at].tolist()), strict=True):
                col += values
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for piece in pieces(batches, "text"):
            langs = np.array([x or "" for x in piece["lang"]], object)
            classes = char_classes(piece["text"])
            words, bounds = batch(piece["text"])
            buckets = (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            owner = np.repeat(np.arange(len(langs)), np.diff(bounds))
            for lang in set(langs):
                mine = langs == lang
                for kind, n in ((0, classes[mine].sum(axis=0)), (1, np.bincount(buckets[mine[owner]], minlength=1 << BUCKET_BITS))):
                    held[lang, kind] = held[lang, kind] + n if (lang, kind) in held else n
            if len(held) > 256:
                yield emit(held)
                held = {}
        yield emit(held)

    counts = map_batches(docs.select("lang", "text"), run, ddl).groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))
    mine = Window.partitionBy("lang", "kind")
    top = counts.withColumns({"place": F.row_number().over(mine.orderBy(F.desc("n"), "bucket")), "total": F.sum("n").over(mine)})
    out: dict[str, Reference] = {}
    for r in top.where(F.col("place") <= max(rules.common_words, len(CLASSES))).orderBy("lang", "kind", "place").collect():
        ref = out.setdefault(r["lang"], Reference())
        if r["kind"] == 0:
            ref.chars[r["bucket"]] = r["n"]
        elif r["place"] <= rules.common_words:
            ref.buckets, ref.counts, ref.words = np.append(ref.buckets, r["bucket"]), np.append(ref.counts, float(r["n"])), float(r["total"])
    return out


def measure(piece: dict[str, list], refs: dict[str, Reference], rules: Rules) -> dict[str, list]:
    """Counts, distances and verdict of the texts of a piece."""
    texts, langs = piece["text"], np.array([x or "" for x in piece["lang"]], object)
    classes = char_classes(texts)
    words, bounds = batch(texts)
    n_words, n_chars = np.diff(bounds), classes.sum(axis=1)
    repeated = repeated_words(words, bounds, rules.window)
    owner = np.repeat(np.arange(len(texts)), n_words)
    buckets = (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    by_char, by_word = np.zeros(len(texts)), np.zeros(len(texts))
    for lang in set(langs):
        ref, mine = refs.get(lang, Reference()), np.flatnonzero(langs == lang)
        if ref.chars.sum() >= rules.reference_chars:
            by_char[mine] = np.where(n_chars[mine] >= rules.char_guard, distance(classes[mine], ref.chars), 0.0)
        if ref.words >= rules.reference_words:
            column = np.full(1 << BUCKET_BITS, len(ref.buckets), np.int64)
            column[ref.buckets] = np.arange(len(ref.buckets))
            place = np.full(len(texts), -1)
            place[mine] = np.arange(len(mine))
            held, width = place[owner] >= 0, len(ref.buckets) + 1
            p = np.bincount(place[owner[held]] * width + column[buckets[held]], minlength=len(mine) * width).reshape(len(mine), width)
            by_word[mine] = np.where(n_words[mine] >= rules.word_guard, distance(p, np.append(ref.counts, max(0.0, ref.words - ref.counts.sum()))), 0.0)
    failed = (n_words < rules.least_words) | (100 * repeated > rules.most_repeated * n_words)
    return {
        "doc_id": piece["doc_id"], "n_words": n_words, "word_chars": n_chars - classes[:, SPACE], "n_symbols": classes[:, SYMBOL], "n_dup_lines": [duplicate_lines(t) for t in texts], "n_repeat_words": repeated,
        "base_failed": failed, "char_distance": by_char, "word_distance": by_word, "kept": ~failed & (by_char <= rules.char_distance) & (by_word <= rules.word_distance),
    }


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row for each document: its counts, its two distances, and whether it is kept.

    Null and empty texts have no words and fail; a null language is a language
    of its own; a language with too little text has no reference, and a text
    under a guard's length is not held against it (distance 0). Repeated rows
    are judged alike. Other columns of ``docs`` are not looked at. The table is
    read twice; only bucket counts are shuffled.
    """
    refs = references(docs, rules)
    given = docs.sparkSession.sparkContext.broadcast(refs)  # some thousand numbers a language
    ddl = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"
    return map_rows(docs.select("doc_id", "text", "lang"), lambda piece: measure(piece, given.value, rules), ddl)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and the verdict by divergence of every document."""
    return judge(table(spark, sf_dir, "documents"))
