"""Substring dedup: documents parsed against every indexed reference block.

A relative Lempel-Ziv parse writes a document as copies (factors) from
references. Here the references are blocks of all documents. A block is an
anchor - the least hashed 8-word sequence of some 50-word window - with up to
42 words on either side, so it holds every window that the anchor stands for.
Equal windows have equal anchors at equal places, so the index of blocks loses
no window.

* A document whose whole block equals that of a smaller document copies it: a
  long factor, settled by one row a block.
* Where blocks share an anchor but not all words - at the ends of passages and
  around edits - factors end inside the block. Only there the windows are
  checked, one by one, by their own hashes.

Greedy factors are then laid over these matches; the words they cover are the
duplicate spans. All keys are two independent 64-bit hashes.

What settles a match is thus the equality of blocks and of windows, by hash, and
not a comparison of words with each reference block that shares an anchor: a
phrase that thousands of different blocks hold would make a pair of each two of
them. The result is the same, that of every window against every reference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import counted, cut, map_rows, table, written
from .words import OTHER, Ranges, batch, encode, mix, sliding_min, starts

_PLACE = np.uint64((1 << 28) - 1)


@dataclass(frozen=True)
class Windows:
    """Words in a window that counts as duplicate, and in its anchor."""

    window: int = 50
    anchor: int = 8

    @property
    def side(self) -> int:
        return self.window - self.anchor


def anchors(words: np.ndarray, bounds: np.ndarray, how: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the place of each window's anchor, and the hash of the anchor at each place."""
    grams = starts(bounds, how.anchor)
    at = starts(bounds, how.window)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    hashed = np.zeros(len(words), np.uint64)
    hashed[grams] = Ranges(words, OTHER).of(grams, grams + how.anchor)
    order = np.full(len(words), np.iinfo(np.uint64).max)
    order[grams] = (hashed[grams] & ~_PLACE) | grams.astype(np.uint64)
    return at, (sliding_min(order, how.side + 1)[at] & _PLACE).astype(np.int64), hashed


def blocks(docs: DataFrame, how: Windows) -> DataFrame:
    """anchor, block, doc_id, at: each anchor of each text, and the hash of its block."""

    def work(piece: dict[str, list]) -> dict[str, list]:
        words, bounds = batch(piece["text"])
        _, place, hashed = anchors(words, bounds, how)
        p = np.unique(place)
        owner = np.searchsorted(bounds, p, side="right") - 1
        lo, hi = np.maximum(bounds[owner], p - how.side), np.minimum(bounds[owner + 1], p + how.window)
        block = mix(Ranges(words).of(lo, hi) + mix((p - lo).astype(np.uint64)))
        return {"anchor": hashed[p].view(np.int64), "block": block.view(np.int64), "doc_id": np.array(piece["doc_id"], np.int64)[owner], "at": p - bounds[owner]}

    return map_rows(docs, work, "anchor long, block long, doc_id long, at int")


def windows(docs: DataFrame, how: Windows) -> DataFrame:
    """h1, h2, doc_id, at: the windows whose anchor lies at one of the document's ``open`` places."""

    def work(piece: dict[str, list]) -> dict[str, list]:
        words, bounds = batch(piece["text"])
        at, place, _ = anchors(words, bounds, how)
        wanted = np.zeros(len(words) + 1, bool)
        for start, places in zip(bounds, piece["open"], strict=False):
            wanted[start + np.array(places, np.int64)] = True
        at = at[wanted[place]]
        owner = np.searchsorted(bounds, at, side="right") - 1
        h1, h2 = (Ranges(words, base).of(at, at + how.window).view(np.int64) for base in (np.uint64(0xA0761D6478BD642F), OTHER))
        return {"h1": h1, "h2": h2, "doc_id": np.array(piece["doc_id"], np.int64)[owner], "at": at - bounds[owner]}

    return map_rows(docs, work, "h1 long, h2 long, doc_id long, at int")


def factors(matches: list[tuple[int, int, int, int]]) -> list[dict]:
    """Greedy factors over matches (start, end, reference, its start).

    Matches that go on in the same reference are one. From the first word that
    is not covered, the match that reaches furthest is taken.
    """
    joined: list[list[int]] = []
    for start, end, ref, at in sorted(matches, key=lambda m: (m[2], m[3] - m[0], m[0])):
        last = joined[-1] if joined else None
        if last and last[2] == ref and last[3] - last[0] == at - start and start <= last[1]:
            last[1] = max(last[1], end)
        else:
            joined.append([start, end, ref, at])
    joined.sort()
    out: list[dict] = []
    here, i, best = 0, 0, None
    while True:
        while i < len(joined) and joined[i][0] <= here:
            best = joined[i] if best is None or joined[i][1] > best[1] else best
            i += 1
        if best is not None and best[1] > here:
            out.append({"start": here, "length": best[1] - here, "ref_doc": best[2], "ref_start": best[3] + here - best[0]})
            here = best[1]
        elif i < len(joined):
            here = joined[i][0]
        else:
            return out


def matches(docs: DataFrame, how: Windows) -> tuple[DataFrame, DataFrame]:
    """Of each document: blocks found in a smaller one (doc_id, blocks), windows found in one (doc_id, hits).

    ``docs`` has doc_id (not null) and text. Minima are combined before each
    shuffle and joined back in joins that Spark can split, so that a passage
    may occur in any share of the documents.
    """
    every = written(blocks(docs, how))
    shared = cut(every.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"))
    rows = written(every.join(shared, "anchor", "left_semi"))
    first = written(rows.groupBy("anchor", "block").agg(F.min(F.struct("doc_id", "at")).alias("first")))
    mixed = cut(first.groupBy("anchor").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select("anchor", F.lit(True).alias("mixed")))
    placed = rows.join(first, ["anchor", "block"]).join(mixed, "anchor", "left")
    copied = F.col("doc_id") > F.col("first.doc_id")
    settled = placed.where(copied | F.coalesce("mixed", F.lit(False))).groupBy("doc_id").agg(
        F.collect_list(F.when(copied, F.struct("at", F.col("first.doc_id").alias("ref"), F.col("first.at").alias("ref_at")))).alias("blocks"),
        F.collect_list(F.when(~copied, F.col("at"))).alias("open"),
    )
    settled = written(settled)
    asking = settled.where(F.size("open") > 0).select("doc_id", "open")
    texts = docs.join(counted(asking.select("doc_id")), "doc_id", "left_semi").join(asking, "doc_id").select("text", "doc_id", "open")
    seen = written(windows(texts, how))
    least = seen.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last").drop("last")
    hits = seen.join(least, ["h1", "h2"]).where("doc_id > first.doc_id")
    hits = hits.groupBy("doc_id").agg(F.collect_list(F.struct("at", F.col("first.doc_id").alias("ref"), F.col("first.at").alias("ref_at"))).alias("hits"))
    return settled.select("doc_id", "blocks"), hits


def parse(docs: DataFrame, how: Windows = Windows()) -> DataFrame:
    """doc_id, n_words, n_removed, factors, kept: the words outside of factors, joined by spaces.

    Factors are (start, length, ref_doc, ref_start) in words; each copies words
    of a smaller document, and together they cover exactly the words of windows
    that also start in a document with a smaller doc_id. Texts shorter than a
    window, empty and null ones have no factor. Rows with a null doc_id are
    neither parsed nor references; of rows that repeat a doc_id none is smaller
    than the other, so they are parsed alike. Other columns are not looked at.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = narrow.where("doc_id is not null")
    found, hits = matches(known, how)
    side, window = how.side, how.window

    def work(piece: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "factors", "kept")}
        for text, in_blocks, in_hits in zip(piece["text"], piece["blocks"], piece["hits"], strict=True):
            words = encode(text).split()
            n = len(words)
            lists = [(max(0, x["at"] - side), min(n, x["at"] + window), x["ref"], x["ref_at"] - min(side, x["at"])) for x in in_blocks or []]
            lists += [(x["at"], x["at"] + window, x["ref"], x["ref_at"]) for x in in_hits or []]
            parsed = factors(lists)
            for f in reversed(parsed):
                del words[f["start"] : f["start"] + f["length"]]
            for c, v in zip(out, (n, n - len(words), parsed, b" ".join(words).decode("utf-8", "replace")), strict=True):
                out[c].append(v)
        return {"doc_id": piece["doc_id"]} | out

    none = "array<struct<at:int,ref:bigint,ref_at:int>>"
    joined = known.join(found, "doc_id", "left").join(hits, "doc_id", "left").select("text", "doc_id", "blocks", "hits")
    alone = narrow.where("doc_id is null").select("text", "doc_id", F.lit(None).cast(none).alias("blocks"), F.lit(None).cast(none).alias("hits"))
    return map_rows(joined.unionByName(alone), work, "doc_id long, n_words long, n_removed long, factors array<struct<start:int,length:int,ref_doc:long,ref_start:int>>, kept string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that 50-word windows share with smaller documents, removed."""
    done = parse(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
with t as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
a as (select doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) as i from t),
k as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as s from a),
m as (select s, min(doc_id) as d from k group by s),
c as (select distinct doc_id, i + unnest(range(0, 50)) as p from k join m using (s) where d < doc_id),
p as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from t),
r as (select p.doc_id, count(*) as n_removed from p join c using (doc_id, p) group by all),
q as (select p.doc_id, string_agg(x, ' ' order by p.p) as s from p anti join c using (doc_id, p) group by p.doc_id)
select t.doc_id, len(t.w)::BIGINT as n_words, coalesce(n_removed, 0)::BIGINT as n_removed, sha256(coalesce(s, '')) as kept_sha256
from t left join r using (doc_id) left join q using (doc_id)
"""
