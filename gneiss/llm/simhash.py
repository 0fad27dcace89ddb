"""SimHash near-dedup: fingerprints compared around the words of a covering code.

Anchors are the words of a code that covers all 64-bit strings: the direct sum
of perfect codes over blocks of bits (Golay, Hamming, repetition), in each of
which every string has exactly one code word within the covering radius.
Fingerprints go to the anchors around them and are compared anchor by anchor.

Two fingerprints that differ in t bits have a string midway, no more than
ceil(t / 2) bits from either, and the anchor that covers that string is within
its covering radius plus that margin of both. So a margin of half the threshold
on either side loses no pair; sending one side to its own anchor and the other
one a whole threshold beyond the radius finds the same pairs with some
twenty times the copies. What goes beyond the radius is counted block by block,
which leaves out most anchors that a ball over all bits would hold.

Links are needed up to connectivity. Equal fingerprints are one row from the
start. The fingerprints of an anchor meet in one shuffle; where they are at most
``MEMBERS`` a task compares all of them and gives a link a fingerprint to the
least one that it reaches there, so that work and links grow with the rows.
Anchors with more are held against a pivot first, the fingerprint that most
documents have; once components of all these links are known, only pairs of
different components are compared, in a join that Spark can split however many
fingerprints an anchor has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .components import components
from .jobs import arrow_schema, counted, cut, map_batches, map_rows, table, written
from .words import encode

SEED = 42
#: Hashes whose bits are added up at once.
HASHES = 65_536
#: Fingerprints that are sent to their anchors at once, and about as many as a partition of them has.
ROWS = 512
PART_ROWS, PARTS = 5_000, 20_000
#: Fingerprints of one anchor that a task compares with one another, and how many of them with all at once.
MEMBERS, TOGETHER = 4_096, 256


@dataclass(frozen=True)
class Perfect:
    """A perfect cyclic code: length, generator polynomial, covering radius."""

    length: int
    generator: int
    radius: int

    @property
    def parity(self) -> int:
        return self.generator.bit_length() - 1

    def remainder(self, words: np.ndarray) -> np.ndarray:
        """The syndrome of each word."""
        out = words.copy()
        for bit in range(self.length - 1, self.parity - 1, -1):
            out ^= ((out >> np.uint64(bit)) & np.uint64(1)) * np.uint64(self.generator << (bit - self.parity))
        return out

    def errors(self, margin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each syndrome, the error patterns up to ``margin`` beyond the radius: patterns, bits beyond, and where syndromes begin."""
        patterns = np.array([sum(1 << b for b in bits) for w in range(min(self.radius + margin, self.length) + 1) for bits in combinations(range(self.length), w)], np.uint64)
        beyond = np.maximum(np.bitwise_count(patterns).astype(np.int64) - self.radius, 0)
        syndrome = self.remainder(patterns).astype(np.int64)
        order = np.lexsort((beyond, syndrome))
        return patterns[order], beyond[order], np.searchsorted(syndrome[order], np.arange((1 << self.parity) + 1))


GOLAY = Perfect(23, 0b110001110101, 3)
HAMMING = Perfect(7, 0b1011, 1)


def repetition(length: int) -> Perfect:
    return Perfect(length, (1 << length) - 1, length // 2)


#: 2**33 anchors, some 139 of them around a fingerprint at a margin of 2; and 2**26, some 71 around it.
FINE = (GOLAY, GOLAY, HAMMING, HAMMING, repetition(3))
COARSE = (GOLAY, GOLAY, repetition(9), repetition(9))


@dataclass(frozen=True)
class Nearness:
    """Words in a shingle, most differing bits of a link, and the codes over the bits; bits that no code takes are not looked at by anchors."""

    shingle: int = 4
    bits: int = 4
    codes: tuple[Perfect, ...] = FINE

    @property
    def margin(self) -> int:
        return -(-self.bits // 2)


def fingerprint(text: str | None, shingle: int, seed: int = SEED) -> int:
    """Bits set in over half the hashes of the shingles, repeats included; zero without words."""
    words = encode(text, lower=True).split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins, ends = np.concatenate([[0], ends[:-shingle] + 1]), ends[shingle - 1 :]
    ones, n = np.zeros(64, np.int64), len(begins)
    for at in range(0, n, HASHES):
        parts = map(joined.__getitem__, map(slice, begins[at : at + HASHES].tolist(), ends[at : at + HASHES].tolist()))
        hashes = np.array(list(map(xxh64_intdigest, parts, repeat(seed))), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, how: Nearness = Nearness()) -> DataFrame:
    """doc_id, bits: the fingerprint of each text as a long."""
    shingle = how.shingle

    def work(piece: dict[str, list]) -> dict[str, list]:
        return {"doc_id": piece["doc_id"], "bits": np.array([fingerprint(t, shingle) for t in piece["text"]], np.uint64).view(np.int64)}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, bits long")


class Anchors:
    """The anchors around fingerprints, as numbers of the code's words."""

    def __init__(self, codes: tuple[Perfect, ...], margin: int):
        if sum(c.length for c in codes) > 64:
            raise ValueError("codes over more than 64 bits")
        self.codes, self.margin = codes, margin
        self._errors = [c.errors(margin) for c in codes]

    def of(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``bits`` and anchors, a row for each anchor within radius and margin."""
        row, anchor, beyond = np.arange(len(bits)), np.zeros(len(bits), np.uint64), np.zeros(len(bits), np.int64)
        shift = 0
        for code, (patterns, more, begin) in zip(self.codes, self._errors, strict=True):
            words = (bits >> np.uint64(shift)) & np.uint64((1 << code.length) - 1)
            shift += code.length
            syndrome = code.remainder(words).astype(np.int64)[row]
            n = begin[syndrome + 1] - begin[syndrome]
            of = np.repeat(np.arange(len(row)), n)
            entry = np.arange(len(of)) + np.repeat(begin[syndrome] - (np.cumsum(n) - n), n)
            total = beyond[of] + more[entry]
            near = total <= self.margin
            of, entry, beyond = of[near], entry[near], total[near]
            row = row[of]
            anchor = (anchor[of] << np.uint64(code.length - code.parity)) | ((words[row] ^ patterns[entry]) >> np.uint64(code.parity))
        return row, anchor


def replicas(nodes: DataFrame, how: Nearness) -> DataFrame:
    """anchor, bits, docs: each fingerprint once for every anchor around it."""
    ddl = "anchor long, bits long, docs long"
    schema, codes, margin = arrow_schema(ddl), how.codes, how.margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = Anchors(codes, margin)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                bits, docs = (part.column(c).to_numpy() for c in ("bits", "docs"))
                row, anchor = around.of(bits.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(bits[row]), pa.array(docs[row])], schema=schema)

    return map_batches(nodes.select("bits", "docs"), run, ddl)


def reached(bits: np.ndarray, most: int) -> np.ndarray:
    """Of each of a few fingerprints, the position of the first one that links between them lead to."""
    near = np.concatenate([np.bitwise_count(bits[at : at + TOGETHER, None] ^ bits) <= most for at in range(0, len(bits), TOGETHER)])
    label = np.arange(len(bits))
    if near.sum() == len(bits):
        return label
    while True:
        new = np.array([label[x].min() for x in near])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def within(lists: DataFrame, how: Nearness) -> DataFrame:
    """a, b: links that connect the fingerprints of each anchor as all links between them do. Rows of an anchor follow one another."""
    ddl, most = "a long, b long", how.bits
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, bits = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in chain(batches, [None]):
            if b is not None:
                anchor = np.append(anchor, b.column("anchor").to_numpy())
                bits = np.append(bits, b.column("bits").to_numpy().view(np.uint64))
            ends = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            ends = np.append(ends, len(anchor)) if b is None and len(anchor) else ends
            out, at = [], 0
            for end in ends.tolist():
                group, at = bits[at:end], end
                label = reached(group, most)
                out.append(np.stack([group, group[label]])[:, label != np.arange(len(group))])
            anchor, bits = anchor[at:], bits[at:]
            if out:
                a, c = np.concatenate(out, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], schema=schema)

    return map_batches(lists.select("anchor", "bits"), run, ddl)


def linked(nodes: DataFrame, how: Nearness) -> DataFrame:
    """id, component: of each fingerprint that is linked with another one, the least fingerprint it can reach."""
    parts = max(1, min(PARTS, -(-nodes.count() // PART_ROWS)))
    every = replicas(nodes.repartition(parts, "bits"), how)
    # An anchor with one fingerprint has no pair; with 2**33 anchors few have several by chance.
    held = Window.partitionBy("anchor").orderBy(F.desc("docs"), "bits")
    whole = held.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    every = every.repartition(parts, "anchor").select("anchor", "bits", F.first("bits").over(whole).alias("pivot"), F.count(F.lit(1)).over(whole).alias("rows"))
    lists = written(every.where("rows > 1"))
    small = lists.where(F.col("rows") <= MEMBERS)
    links = within(small.repartition(max(1, min(PARTS, -(-lists.count() // PART_ROWS))), "anchor").sortWithinPartitions("anchor"), how)
    lists = lists.where(F.col("rows") > MEMBERS).select("anchor", "bits", "pivot")
    near = F.bit_count(F.col("bits").bitwiseXOR(F.col("pivot"))) <= how.bits
    stars = lists.where(near & (F.col("bits") != F.col("pivot"))).select(F.col("bits").alias("a"), F.col("pivot").alias("b"))
    stars = cut(links.unionByName(stars).distinct())
    found = components(stars)
    known = counted(found)
    placed = lists.join(known, F.col("bits") == F.col("id"), "left").select("anchor", "bits", "pivot", F.coalesce("component", "bits").alias("own"))
    of_pivot = found.select(F.col("id").alias("p"), F.col("component").alias("pc"))
    placed = placed.join(counted(of_pivot), F.col("pivot") == F.col("p"), "left").select("anchor", "bits", "own", F.coalesce("pc", "pivot").alias("main"))
    placed = written(placed)
    # A pair of different components has at least one side outside of the pivot's; that side asks.
    x = placed.where("own <> main").select("anchor", F.col("bits").alias("a"), F.col("own").alias("a_own"))
    y = placed.select("anchor", F.col("bits").alias("b"), F.col("own").alias("b_own"))
    pairs = x.join(y, (x["anchor"] == y["anchor"]) & (F.col("a_own") != F.col("b_own")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= how.bits))
    more = cut(pairs.select(F.least("a_own", "b_own").alias("a"), F.greatest("a_own", "b_own").alias("b")).distinct())
    if not more.limit(1).count():
        return found
    joined = components(more)
    every = found.select("id", F.col("component").alias("c")).unionByName(joined.select("id", F.col("id").alias("c")))
    return every.join(joined.select(F.col("id").alias("c"), "component"), "c", "left").groupBy("id").agg(F.min(F.coalesce("component", "c")).alias("component"))


def near(docs: DataFrame, how: Nearness = Nearness()) -> DataFrame:
    """A row for each document: doc_id, fingerprint, component_id.

    ``component_id`` is the least doc_id that links lead to, the document itself
    included. Texts without words, empty and null ones have fingerprint zero,
    which links like any other. Rows with a null doc_id have a fingerprint but
    link with nothing; repeated rows give repeated results. Other columns are
    not looked at.
    """
    rows = written(fingerprints(docs, how))
    nodes = written(rows.where("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("docs")))
    found = linked(nodes, how)
    led = nodes.join(found, nodes["bits"] == found["id"], "left").select("bits", "first", F.coalesce("component", "bits").alias("component"))
    least = led.groupBy("component").agg(F.min("first").alias("component_id"))
    final = written(led.join(least, "component").select("bits", "component_id"))
    named = F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint")
    return rows.join(final, "bits", "left").select("doc_id", named, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints of 4-word shingles differ in at most 4 bits."""
    return near(table(spark, sf_dir, "documents"))
