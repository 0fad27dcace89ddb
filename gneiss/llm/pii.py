r"""Personal data: patterns, and the terms that give protected entities away.

Patterns find e-mail addresses, IP numbers, card and phone numbers. Each value
found is a protected entity. A term of a document with an entity discloses it as far as
seeing the term tells that the entity is there: the pointwise mutual
information of both over the documents of the corpus, as a share of the
entity's own information content. ::

    PMI(c; t) = log(n(c,t) * N / (n(c) * n(t)))     IC(c) = log(N / n(c))

From ``PMI >= remove * IC`` on a term is removed, from ``PMI >= generalise *
IC`` on it is replaced by what kind of term it is, wherever it stands in a
document that holds the entity. Documents in which the
entity has the same context count once, so that copies of one document do not
make all its rare words disclosing. What one of the documents says of the pair
is estimated from the others, smoothed by one document at the entity's own rate::

    P(c | t) = (n(c,t) - 1 + P(c)) / n(t)     PMI(c; t) = log(P(c | t) / P(c))

so two documents are evidence already, and one alone, all of whose rare words
would have the full share, is none.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import counted, cut, map_batches, map_rows, slices, table, written

KINDS = ("email", "ip", "card", "phone", "term", "general")
BASE_KINDS = 4
#: The name of added spans while they stand beside a caller's own columns.
ADDED = "_gneiss_added"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is taken whole, so that a long one costs no more than its length.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TERM = re.compile(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Disclosure:
    """Thresholds. ``reach``: characters on either side of an entity whose terms tell copies apart."""

    reach: int = 120
    least_letters: int = 4
    remove: float = 0.9
    generalise: float = 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: the characters before each @, then its domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, by start and then kind."""
    if not text or not _ANY.search(text):
        return []
    out = [(s, 0, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def mentions(text: str, spans: list[tuple[int, int, int]], how: Disclosure) -> tuple[list[dict], list[dict]]:
    """The entities of the text, each with its first context, and the terms of the text with all their places."""
    begins = [s for s, *_ in spans]
    reached = list(accumulate((e for *_, e in spans), max))  # where the spans up to each one end

    def taken(s: int, e: int) -> bool:
        i = bisect_left(begins, e)
        return i > 0 and reached[i - 1] > s

    words = [(m.start(), m.end(), m[0].translate(_FOLD)) for m in _TERM.finditer(text) if m.end() - m.start() >= how.least_letters and not taken(m.start(), m.end())]
    starts, held, terms = [s for s, *_ in words], {}, {}
    for start, kind, end in spans:
        value = text[start:end].lower() if kind < 2 else re.sub("[^0-9]", "", text[start:end])
        entity = f"{KINDS[kind]}:{value}"
        if entity not in held:
            near = words[bisect_left(starts, start - how.reach) : bisect_left(starts, end + how.reach)]
            # Without a term nearby, the whole text is the context.
            said = " ".join(t for _, e, t in near if e <= end + how.reach) or text
            held[entity] = {"entity": entity, "context": int.from_bytes(hashlib.blake2b(said.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)}
    for s, e, term in words:
        terms.setdefault(term, []).append({"start": s, "end": e})
    return list(held.values()), [{"term": term, "places": places} for term, places in terms.items()]


def scan(docs: DataFrame, how: Disclosure) -> DataFrame:
    """doc_id, text_key (a hash of the text), base: the patterns' spans, held: entities, terms: those of documents that hold entities."""

    def work(piece: dict[str, list]) -> dict[str, list]:
        spans = [base_spans(t) for t in piece["text"]]
        found = [mentions(t, x, how) if x else ([], []) for t, x in zip(piece["text"], spans, strict=True)]
        return {
            "doc_id": piece["doc_id"],
            "text_key": piece["text_key"],
            "base": [[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in spans],
            "held": [x for x, _ in found],
            "terms": [x for _, x in found],
        }

    ddl = "doc_id long, text_key long, base array<struct<start:int,kind:int,end:int>>, held array<struct<entity:string,context:long>>, terms array<struct<term:string,places:array<struct<start:int,end:int>>>>"
    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), work, ddl)


def together(found: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, text_key, entity, context, term, places: the entities with each term of the documents that hold them."""
    rows = found.select("doc_id", "text_key", F.explode("held").alias("h"), "terms").select("doc_id", "text_key", "h.entity", "h.context", "terms")
    rows = rows.join(counted(entities), "entity", "left_semi").select("doc_id", "text_key", "entity", "context", F.explode("terms").alias("t"))
    return rows.select("doc_id", "text_key", "entity", "context", "t.term", "t.places")


def same_text(left: DataFrame, doc_id: str, text_key: str):  # noqa: ANN201
    """Rows of the same document and text; a null doc_id equals another."""
    return left["doc_id"].eqNullSafe(F.col(doc_id)) & (F.col("text_key") == F.col(text_key))


def disclosing(docs: DataFrame, found: DataFrame, how: Disclosure) -> DataFrame:
    """entity, term, share (PMI as a share of IC), kind (4: remove, 5: generalise).

    All counts are of documents and run over all of them. They are combined
    before each shuffle, so a frequent entity or term makes no large group, and
    of the words of the corpus each task sends every one once.
    """
    held = found.select(F.explode("held").alias("h")).select("h.entity", "h.context").groupBy("entity", "context").agg(F.count(F.lit(1)).alias("n"))
    # One context has no share above 0.
    n_entity = written(held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where("n_entity > 1"))
    near = together(found, n_entity.select("entity"))
    pairs = near.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_both"))
    pairs = written(pairs.where("n_both > 1"))
    total = F.lit(float(docs.count()))

    def share(n_term: str):  # noqa: ANN202
        rate = F.col("n_entity") / total
        once = F.col(n_term) - F.col("n_docs") + F.col("n_both")  # the entity's copies count once
        return F.when(rate < 1, -F.log((F.col("n_both") - 1 + rate) / once / rate) / F.log(rate)).otherwise(0.0)

    # A term is in as many documents at least as hold any entity: that alone rules most pairs out.
    n_near = found.select(F.explode("terms.term").alias("term")).join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    pairs = cut(pairs.join(n_entity, "entity").join(n_near, "term").where(share("n_near") >= min(how.remove, how.generalise)))
    folded = F.split(F.translate("text", UPPER, LOWER), r"[\x00-\x40\x5b-\x60\x7b-\x7f]+")
    words = docs.select(F.explode(F.array_distinct(folded)).alias("term")).where(F.char_length("term") >= how.least_letters)
    n_term = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    out = pairs.join(n_term, "term").withColumn("share", share("n_term"))
    kind = F.when(F.col("share") >= how.remove, 4).when(F.col("share") >= how.generalise, 5)
    return out.withColumn("kind", kind).where("kind is not null").select("entity", "term", "share", "kind")


def find(docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """A row for each document: doc_id, ``text_key``, ``base`` spans, and the spans ``added`` by disclosure.

    Spans are (start, kind, end) in code points, end exclusive, kinds numbered
    as in :data:`KINDS`. Null and empty texts have none. Repeated rows count as
    documents each. Added spans belong to a doc_id (null too) and a text, so that
    rows which repeat an id with other texts have their own. Other columns are
    not looked at.
    """
    found = written(scan(docs, how))
    pairs = written(disclosing(docs, found, how))
    spot = F.col("p")
    near = together(found, cut(pairs.select("entity").distinct()))
    spans = near.join(pairs.drop("share"), ["entity", "term"]).select("doc_id", "text_key", "kind", F.explode("places").alias("p"))
    added = spans.groupBy("doc_id", "text_key", spot["start"].alias("start"), spot["end"].alias("end")).agg(F.min("kind").alias("kind"))
    added = added.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = found.select("doc_id", "text_key", "base")
    return found.join(written(added), same_text(found, "_id", "_key"), "left").select("doc_id", "text_key", "base", F.coalesce("added", none).alias("added"))


def rewrite(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text without its spans: values and generalised terms by their kind, removed terms not at all."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start < at:  # inside or over the end of the span before
            at = max(at, end)
            continue
        out.append(text[at:start])
        if kind < BASE_KINDS:
            out.append(f"<{KINDS[kind].upper()}>")
        elif kind == 5:
            out.append("<NAME>" if text[start : start + 1].isupper() else "<TERM>")
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """The documents with all spans rewritten; ``n_chars`` is that of the new text.

    Base spans are found again where the text is, so only added spans are
    joined to it; those are few unless a corpus discloses a lot.
    """
    spans = find(docs, how).where(F.size("added") > 0).select(F.col("doc_id").alias(f"{ADDED}_id"), F.col("text_key").alias(f"{ADDED}_key"), F.col("added").alias(ADDED))
    spans = written(spans.dropDuplicates([f"{ADDED}_id", f"{ADDED}_key"]))
    own = docs["doc_id"].eqNullSafe(spans[f"{ADDED}_id"]) & (F.xxhash64(docs["text"]) == spans[f"{ADDED}_key"])
    with_spans = docs.join(spans, own, "left").select(*[docs[c] for c in docs.columns], ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            c = b.select(["text", ADDED]).to_pydict()
            new = [rewrite(t, base_spans(t) + [(x["start"], x["kind"], x["end"]) for x in more or []]) for t, more in zip(c["text"], c[ADDED], strict=True)]
            made = {"text": new, "n_chars": [None if t is None else len(t) for t in new]}
            fields = [f for f in b.schema if f.name != ADDED]
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else b.column(f.name) for f in fields], schema=pa.schema(fields))

    return map_batches(with_spans, run, docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All personal data of every document: counts of the base kinds, their digest, all spans."""
    found = find(table(spark, sf_dir, "documents"))
    label = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):  # noqa: ANN001, ANN202
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(label, x["kind"] + 1), x["start"], x["end"])), ",")

    def number(kind: int):  # noqa: ANN202
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [number(k) for k in range(BASE_KINDS)]
    everything = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(everything).alias("spans"))
