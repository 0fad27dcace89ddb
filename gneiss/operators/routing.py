"""Which part of a partitioned table a row goes to.

Bounds are texts as a catalog prints them: ranges, lists, hash remainders and a
default part. They become one expression over the key: a binary search in the
sorted lower bounds, a look-up of listed values, or a remainder, so a row costs
the logarithm of the parts at most and nothing is joined or shuffled. Rows that
no part takes have a null part.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spelling

_KEY = re.compile(r"(?is)^\s*(RANGE|LIST|HASH)\s*\((.*)\)\s*$")
_RANGE = re.compile(r"(?is)^FOR VALUES FROM \((.*)\) TO \((.*)\)$")
_LIST = re.compile(r"(?is)^FOR VALUES IN \((.*)\)$")
_HASH = re.compile(r"(?is)^FOR VALUES WITH \(modulus ([0-9]+), remainder ([0-9]+)\)$")
_VALUE = re.compile(r"\s*(NULL|MINVALUE|MAXVALUE|'(?:[^']|'')*'|-?[0-9]+(?:\.[0-9]+)?|true|false)(?:::[a-z ]+(?:\([0-9, ]+\))?)?\s*(,|$)", re.I)


class Unrouted(ValueError):
    """Bounds that are not read, or that leave open where a row goes."""


@dataclass(frozen=True)
class Parted:
    """A partition key such as ``RANGE (l_shipdate)``, and (name, bound) of each part."""

    key: str
    parts: tuple[tuple[str, str], ...]


def _values(text: str) -> list[str | None]:
    """Values of a bound; null as None, the ends of a range by their names."""
    out, at = [], 0
    while at < len(text):
        if not (m := _VALUE.match(text, at)):
            raise Unrouted(f"bound {text!r} is not read")
        v, at = m[1], m.end()
        out.append(None if v.upper() == "NULL" else v[1:-1].replace("''", "'") if v[0] == "'" else v.upper() if v.upper().endswith("VALUE") else v)
    return out


def _default(parted: Parted) -> str | None:
    found = [n for n, b in parted.parts if b.strip().upper() == "DEFAULT"]
    if len(found) > 1:
        raise Unrouted("two default parts")
    return found[0] if found else None


def bucket(key: Column, modulus: int) -> Column:
    """The remainder of a key: 32 bits of the MD5 of its text; a null key has remainder 0."""
    return F.coalesce(F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(modulus)), F.lit(0)).cast("int")


def _ranged(key: Column, kind: str, parts: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(part, do bounds cross or end before they begin) by binary search."""
    rows = []
    for name, bound in parts:
        if not (m := _RANGE.match(bound)):
            raise Unrouted(f"bound {bound!r} is not read")
        low, high = _values(m[1]), _values(m[2])
        if len(low) != 1 or len(high) != 1 or None in (*low, *high) or low[0] == "MAXVALUE" or high[0] == "MINVALUE":
            raise Unrouted(f"bound {bound!r} is not read")
        end = {"MINVALUE", "MAXVALUE"}
        rows.append(F.struct(*[F.lit(None if v in end else v).cast(kind).alias(c) for c, v in (("low", low[0]), ("high", high[0]))], F.lit(name).alias("part")))
    bounds = F.array_sort(F.array(*rows))  # folded once; an open lower end is null and stands first
    n = len(rows)

    def starts(i: Column) -> Column:
        low = F.get(bounds, i)["low"]
        return (i < n) & (low.isNull() | (low <= key))

    steps = F.array(*[F.lit(1 << b) for b in range(n.bit_length(), -1, -1)])
    at = F.aggregate(steps, F.lit(0), lambda found, step: F.when(starts(found + step - 1), found + step).otherwise(found)) - 1
    hit = F.get(bounds, F.when(at >= 0, at))
    inside = key.isNotNull() & (hit["high"].isNull() | (key < hit["high"]))
    pairs = F.zip_with(F.slice(bounds, 1, max(1, n - 1)), F.slice(bounds, 2, max(1, n - 1)), lambda a, b: F.coalesce(a["high"] > b["low"], b["part"].isNotNull() & (a["high"].isNull() | b["low"].isNull())))
    wrong = F.exists(pairs, lambda x: x) | F.exists(bounds, lambda b: F.coalesce(b["low"] >= b["high"], F.lit(False)))
    return F.when(inside, hit["part"]), wrong


def part_of(df: DataFrame, parted: Parted) -> Column:
    """The name of the part that takes a row; null if none does.

    A null key goes to the part that lists null, or to the default part; ranges
    do not take it. Bounds of texts that cross, values listed twice and parts
    that are not read raise :class:`Unrouted`; dates, numbers and texts are
    compared as the key's own type.
    """
    if not (m := _KEY.match(parted.key)):
        raise Unrouted(f"key {parted.key!r} is not read")
    try:
        text, names = spelling.predicate(m[2])
    except spelling.Unread as why:
        raise Unrouted(f"key {parted.key!r} is not read") from why
    if not names or "," in re.sub(r"\([^()]*\)", "", m[2]):
        raise Unrouted(f"key {parted.key!r} is not one column")
    how, key, default = m[1].upper(), F.expr(text), _default(parted)
    kind = df.select(key.alias("k")).schema["k"].dataType.simpleString()
    parts = [(n, b.strip()) for n, b in parted.parts if b.strip().upper() != "DEFAULT"]
    if not parts and default is None:
        return F.lit(None).cast("string")
    if how == "HASH":
        if default is not None or not all(_HASH.match(b) for _, b in parts):
            raise Unrouted("hash parts that are not read")
        found = [(n, int(_HASH.match(b)[1]), int(_HASH.match(b)[2])) for n, b in parts]
        modulus = math.lcm(*(k for _, k, _ in found))
        slots: list[str | None] = [None] * modulus
        for name, k, rest in found:
            for at in range(rest, modulus, k):
                if slots[at] is not None:
                    raise Unrouted(f"{slots[at]} and {name} share rows")
                slots[at] = name
        return F.get(F.array(*[F.lit(s).cast("string") for s in slots]), bucket(key, modulus))
    if how == "LIST":
        held: dict[str | None, str] = {}
        for name, bound in parts:
            if not (m := _LIST.match(bound)):
                raise Unrouted(f"bound {bound!r} is not read")
            for v in _values(m[1]):
                if v in held:
                    raise Unrouted(f"{v!r} is in two parts")
                held[v] = name
        listed = F.lit(held.get(None)).cast("string")
        of = F.create_map(*[c for v, n in held.items() if v is not None for c in (F.lit(v).cast(kind), F.lit(n))]) if held.keys() - {None} else None
        found = F.when(key.isNull(), listed).otherwise(F.try_element_at(of, key) if of is not None else F.lit(None).cast("string"))
        return F.coalesce(found, F.lit(default).cast("string"))
    if not parts:
        return F.lit(default)
    found, wrong = _ranged(key, kind, parts)
    if df.sparkSession.range(1).select(wrong.alias("w")).first()["w"]:
        raise Unrouted("ranges that cross")
    return F.coalesce(found, F.lit(default).cast("string"))


def routed(df: DataFrame, parted: Parted, name: str = "part") -> DataFrame:
    """The rows with the name of their part; null for rows that no part takes."""
    return df.withColumn(name, part_of(df, parted))
