"""A quality classifier by co-training of two views.

One classifier sees the text's content (hashed byte trigrams), the other what
there is to know about the page without reading it: source, language, length
and layout (lines, shares of character classes, how often words come back).
Names and length alone tell next to nothing where sources are alike, so layout
is part of the page's view.

Both start from labelled documents. In each round either one labels all other
documents of the corpus, and what it is confident of teaches the *other* one: a
Newton step along the gradient over the labelled and all confidently labelled
documents, as long as does best on held-out labelled rows. Scores of each view
are calibrated on these rows as well, and the calibrated log-odds of both are
added up, less the prior that both contain.

The labelled sample is bounded (``labelled`` documents with the least hash of
their doc_id) and fitted on the driver. Every round is one pass over all texts
in tasks, each of which sends one row of gradient sums; Spark adds them up.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import arrow_schema, map_batches, map_rows, slices, table
from .quality_rules import CLASSES, char_classes, duplicate_lines, repeated_words
from .words import batch, encode

HASHED = 1_024
NAMES = 32  # hash buckets for sources and for languages
_GRAM = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Training:
    """``labelled``: the labelled documents at most that are fitted and held out."""

    labelled: int = 4_000
    rounds: int = 3
    confidence: float = 0.95
    held_out: float = 0.25
    keep_from: float = 0.5


@dataclass
class View:
    """A linear classifier: inputs are standardised, scores calibrated to log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.score(x) + self.offset, -12, 12)


@dataclass
class Model:
    """Both views and the prior log-odds; without views all documents have the prior."""

    prior: float = 0.0
    views: list[View] = field(default_factory=list)

    def log_odds(self, views: list[np.ndarray]) -> list[np.ndarray]:
        return [v.log_odds(x) for v, x in zip(self.views, views, strict=True)] if self.views else [np.full(len(views[0]), self.prior)] * 2


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def content(texts: list[str | None]) -> np.ndarray:
    """Hashed byte trigrams of each text: log counts, scaled to length 1."""
    parts = [encode(t) for t in texts]
    data = np.frombuffer(b"\0\0".join([*parts, b"\0\0"]), np.uint8).astype(np.uint64)
    grams = data[:-2] | (data[1:-1] << np.uint64(8)) | (data[2:] << np.uint64(16))
    at = ((grams * _GRAM) >> np.uint64(64 - HASHED.bit_length() + 1)).astype(np.int64)
    lengths = np.array([len(p) for p in parts], np.int64)
    # A gram for each byte of a text, none for the two bytes between texts.
    inside = np.repeat(np.tile([True, False], len(parts)), np.column_stack([lengths, np.full(len(parts), 2)]).ravel())[: len(grams)]
    counts = np.bincount(np.repeat(np.arange(len(parts)) * HASHED, lengths) + at[inside], minlength=len(parts) * HASHED)
    x = np.log1p(counts.reshape(len(parts), HASHED)).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)


def page(texts: list[str | None], langs: list[str | None], sources: list[str | None]) -> np.ndarray:
    """Metadata of each page: names by hash, length and layout."""
    classes = char_classes(texts)
    words, bounds = batch(texts)
    n, n_chars = np.diff(bounds), classes.sum(axis=1)
    lines = np.array([(t or "").count("\n") + 1 for t in texts])
    again = np.array([duplicate_lines(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), n)
    _, first = np.unique(words + owner.astype(np.uint64) * _GRAM, return_index=True)
    kinds = np.bincount(owner[first], minlength=len(texts))
    shape = np.column_stack([
        np.log1p(n_chars), np.log1p(n), np.log1p(lines), n_chars / lines, (n_chars - classes[:, CLASSES.index("space")]) / np.maximum(n, 1),
        kinds / np.maximum(n, 1), repeated_words(words, bounds, 8) / np.maximum(n, 1), again / lines, classes / np.maximum(n_chars, 1)[:, None],
    ])
    names = np.zeros((len(texts), 2 * NAMES))
    for column, values in enumerate((langs, sources)):
        hashed = [zlib.crc32(encode(v)) % NAMES for v in values]
        names[np.arange(len(texts)), column * NAMES + np.array(hashed, np.int64)] = 1
    return np.hstack([shape, names]).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 150, ridge: float = 1e-3) -> View:
    """Logistic regression by accelerated gradient steps; classes weigh the same."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z, y = ((x - mean) / scale).astype(np.float32), y.astype(np.float32)
    weight = (np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)).astype(np.float32)
    w, b, v, c = np.zeros(z.shape[1], np.float32), np.float32(0), np.zeros(z.shape[1], np.float32), np.float32(0)
    top = np.full(z.shape[1], 1 / np.sqrt(z.shape[1]), np.float32)
    for _ in range(12):  # the largest curvature, by power iteration
        top = z.T @ (weight * (z @ top))
        curve = float(np.linalg.norm(top))
        top /= max(curve, 1e-12)
    rate, ridge = np.float32(1 / (0.25 * (curve + 1) + ridge)), np.float32(ridge)
    for k in range(steps):
        m = np.float32(k / (k + 3))
        pw, pb = w + m * (w - v), b + m * (b - c)
        g = weight * (sigmoid(z @ pw + pb) - y)
        v, c = w, b
        w, b = pw - rate * (z.T @ g + ridge * pw), pb - rate * g.sum()
    return View(mean, scale, w, float(b))


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling: a slope and an offset by Newton steps, on rows that were not trained on."""
    s = view.score(x)
    # Targets away from 0 and 1 keep the slope finite where the rows are separable.
    target = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * s + b)
        r, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([r @ s, r.sum()])
        m = np.array([[h @ (s * s) + 1e-6, h @ s], [h @ s, h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    view.slope, view.offset = max(a, 1e-3), b


#: For each student and label: sums of residual times input, of residuals, and of rows.
Lessons = list[list[np.ndarray]]


def lessons(model: Model, views: list[np.ndarray], how: Training) -> Lessons:
    """What each view has to learn from the documents that the other one is confident of."""
    odds, out = model.log_odds(views), []
    for student, (view, x) in enumerate(zip(model.views, views, strict=True)):
        p, score = sigmoid(odds[1 - student]), sigmoid(view.score(x))
        out.append([])
        for label, sure in ((0, p <= 1 - how.confidence), (1, p >= how.confidence)):
            r = (score[sure] - label).astype(np.float64)
            out[-1].append(np.concatenate([r @ x[sure].astype(np.float64), [r.sum(), sure.sum()]]))
    return out


def learn(view: View, x: np.ndarray, y: np.ndarray, taught: list[np.ndarray], held_x: np.ndarray, held_y: np.ndarray, ridge: float = 1e-2) -> View:
    """The view after one step on its labelled rows and what it was taught; classes weigh the same.

    The direction solves the labelled rows' Hessian by conjugate gradients; the
    length, which may be 0, has the least loss on the rows held out.
    """
    z = ((x - view.mean) / view.scale).astype(np.float64)
    p = sigmoid(view.score(x))
    g, curve = np.append(ridge * view.weights, 0.0), np.zeros(len(y))
    for label in (0, 1):
        mine, sums = y == label, taught[label]
        weight = 0.5 / max(mine.sum() + sums[-1], 1)
        r = p[mine] - label
        g += weight * np.append(r @ z[mine] + (sums[:-2] - view.mean * sums[-2]) / view.scale, r.sum() + sums[-2])
        curve[mine] = 0.5 / max(mine.sum(), 1) * (p * (1 - p))[mine]

    def hessian(v: np.ndarray) -> np.ndarray:
        s = curve * (z @ v[:-1] + v[-1])
        return np.append(s @ z, s.sum()) + ridge * v

    step, left = np.zeros(len(g)), -g
    way, size = left.copy(), float(g @ g)
    for _ in range(60):
        if size < 1e-18:
            break
        h = hessian(way)
        a = size / float(way @ h)
        step, left = step + a * way, left - a * h
        size, was = float(left @ left), size
        way = left + size / was * way

    def moved(t: float) -> View:
        return View(view.mean, view.scale, (view.weights + t * step[:-1]).astype(np.float32), view.bias + t * float(step[-1]))

    def loss(v: View) -> float:
        s = v.score(held_x)
        return sum(np.logaddexp(0, np.where(label, -1, 1) * s[held_y == label]).mean() for label in (0, 1))

    return min((moved(t) for t in (0.0, 0.125, 0.25, 0.5, 1.0, 2.0)), key=loss)


def cotrain(views: list[np.ndarray], y: np.ndarray, teach: Callable[[Model], Lessons], how: Training = Training()) -> Model:
    """``views`` and ``y`` (1 or 0) of the labelled rows, the first of which are held out; ``teach`` gives the lessons of all others."""
    n_held = int(len(y) * how.held_out)
    held_y, first_y = y[:n_held], y[n_held:]
    if len(np.unique(first_y)) < 2 or len(np.unique(held_y)) < 2:
        good = y.mean() if len(y) else 0.5
        return Model(float(np.log((good * len(y) + 1) / ((1 - good) * len(y) + 1))))
    good = float(y.mean())
    model = Model(float(np.log(good / (1 - good))), [fit(x[n_held:], first_y.astype(float)) for x in views])
    for view, x in zip(model.views, views, strict=True):
        calibrate(view, x[:n_held], held_y.astype(float))
    for _ in range(how.rounds):
        taught = teach(model)
        model = Model(model.prior, [learn(v, x[n_held:], first_y, t, x[:n_held], held_y) for v, x, t in zip(model.views, views, taught, strict=True)])
        for view, x in zip(model.views, views, strict=True):
            calibrate(view, x[:n_held], held_y.astype(float))
    return model


def sample(docs: DataFrame, labels: DataFrame, how: Training) -> tuple[list[np.ndarray], np.ndarray, frozenset[int]]:
    """Both views, labels and ids of the labelled sample, in the order of a hash of doc_id.

    Of the rows that share a labelled doc_id the one with the least hash of its
    text is taken, so that the sample is the same under any partitioning.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    ids = docs.where("doc_id is not null").select("doc_id")
    chosen = known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.labelled).collect()
    wanted = {r["doc_id"]: r["y"] for r in chosen}
    if not wanted:
        return [np.zeros((0, 1)), np.zeros((0, 1))], np.zeros(0), frozenset()
    few = spark.createDataFrame([*wanted.items()], "doc_id long, y int")  # labelled rows at most

    def work(piece: dict[str, list]) -> dict[str, list]:
        x = content(piece["text"])
        at = [np.flatnonzero(r) for r in x]
        return {"doc_id": piece["doc_id"], "y": piece["y"], "at": at, "x": [r[i] for r, i in zip(x, at, strict=True)], "page": list(page(piece["text"], piece["lang"], piece["source"]))}

    of = docs.select("doc_id", F.struct(F.xxhash64("text").alias("h"), "text", "lang", "source").alias("d")).join(F.broadcast(few), "doc_id")
    one = of.groupBy("doc_id", "y").agg(F.min("d").alias("d")).select("d.text", "doc_id", "d.lang", "d.source", "y")
    rows = map_rows(one, work, "doc_id long, y int, at array<int>, x array<float>, page array<float>")
    got = rows.toArrow().combine_chunks()  # a row for each labelled document of the sample
    if not got.num_rows:
        return [np.zeros((0, 1)), np.zeros((0, 1))], np.zeros(0), frozenset()
    at, values, shape = (got.column(c).chunk(0) for c in ("at", "x", "page"))
    x = np.zeros((got.num_rows, HASHED), np.float32)
    x[np.repeat(np.arange(got.num_rows), np.diff(at.offsets.to_numpy())), at.values.to_numpy()] = values.values.to_numpy()
    place = {d: i for i, d in enumerate(wanted)}
    order = np.argsort([place[d] for d in got.column("doc_id").to_pylist()], kind="stable")
    return [x[order], shape.values.to_numpy().reshape(got.num_rows, -1)[order]], got.column("y").to_numpy()[order], frozenset(wanted)


def views_of(piece: dict[str, list], size: int = 256) -> Iterator[list[np.ndarray]]:
    """Both views of a piece, some rows at a time."""
    for i in range(0, len(piece["text"]), size):
        texts, langs, sources = (piece[c][i : i + size] for c in ("text", "lang", "source"))
        yield [content(texts), page(texts, langs, sources)]


def taught(docs: DataFrame, model: Model, own: frozenset[int], how: Training) -> Lessons:
    """The lessons of all documents but the labelled sample ``own``: one pass, sums added up by Spark."""
    shared = docs.sparkSession.sparkContext.broadcast((model, own))
    schema = arrow_schema("student int, label int, sums array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, own = shared.value
        total = [[np.zeros(len(v.weights) + 2) for _ in (0, 1)] for v in model.views]
        for part in slices(batches, "text"):
            piece = part.filter(pa.array([d not in own for d in part.column("doc_id").to_pylist()])).to_pydict()
            for views in views_of(piece):
                for mine, more in zip(total, lessons(model, views, how), strict=True):
                    for sums, x in zip(mine, more, strict=True):
                        sums += x
        yield pa.RecordBatch.from_pylist([{"student": s, "label": c, "sums": x} for s, mine in enumerate(total) for c, x in enumerate(mine)], schema=schema)

    rows = map_batches(docs.select("text", "doc_id", "lang", "source"), run, "student int, label int, sums array<double>")
    sums = rows.select("student", "label", F.posexplode("sums").alias("at", "x")).groupBy("student", "label", "at").agg(F.sum("x").alias("x"))
    out = [[np.zeros(len(v.weights) + 2) for _ in (0, 1)] for v in model.views]
    for r in sums.collect():  # two rows for each input of each view, whatever the corpus
        out[r["student"]][r["label"]][r["at"]] = r["x"]
    shared.destroy()
    return out


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """Fit on the sample, then rounds over all documents. Without labels of both classes the model knows the prior alone."""
    views, y, own = sample(docs, labels, how)
    return cotrain(views, y, lambda model: taught(docs, model, own, how), how) if len(y) else Model()


def judged(model: Model, piece: dict[str, list], how: Training) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of quality: by content, by page, by both; and whether it is kept."""
    parts: list[list[np.ndarray]] = [[], []]
    for views in views_of(piece):
        for part, odds in zip(parts, model.log_odds(views), strict=True):
            part.append(odds)
    a, b = (np.concatenate([np.zeros(0), *p]) for p in parts)
    both = sigmoid(a + b - model.prior)
    return sigmoid(a), sigmoid(b), both, both >= how.keep_from


def score(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """doc_id, p_content, p_page, p_quality and kept of every document.

    Null and empty texts are scored by what they are (no trigrams, no length);
    null languages and sources have the bucket of the empty name. Repeated rows
    score alike. Labels that are null or not 0 or 1 are left aside; of labels
    that contradict each other the lower counts. Other columns are not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, how))

    def work(piece: dict[str, list]) -> dict[str, list]:
        a, b, both, kept = judged(model.value, piece, how)
        return {"doc_id": piece["doc_id"], "p_content": a, "p_page": b, "p_quality": both, "kept": kept}

    return map_rows(docs.select("text", "doc_id", "lang", "source"), work, "doc_id long, p_content double, p_page double, p_quality double, kept boolean")


def accepted(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """The documents that are kept, with all their columns; texts are not shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, how))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ok = judged(model.value, part.select(["text", "lang", "source"]).to_pydict(), how)[3]
            yield part.filter(pa.array(ok))

    return map_batches(docs, keep, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, by co-training from the labels."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
