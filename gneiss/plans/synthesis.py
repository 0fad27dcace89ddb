"""Tables from a catalog: how many rows, and the expression of each column.

Every table is ``spark.range(n)`` with one expression a column. A reference
takes the key that its parent's expression gives for the parent's row, so it
needs no join, however large both tables are. Constraints decide the
expressions; what cannot be satisfied is refused by name.
"""

from __future__ import annotations

import datetime
import math
import re
from collections.abc import Callable, Collection, Iterable, Mapping
from dataclasses import dataclass, replace
from decimal import Decimal
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, nouns, shapes, types
from ..functions.cells import Bounds
from ..operators import graph
from ..operators.foreign_keys import parent_row
from ..operators.validate import duplicates, failed, orphans
from ..sources.catalog import Catalog, Field, Reference, Table, frames

#: Readings of check texts and of column names, kept for the next plan; catalogs are small and repeat their texts.
_CHECKS: dict[str, list[Row]] = {}
_NAMES: dict[tuple[str, str], Row] = {}
#: Sizes of the nouns whose lists are closed.
_CLOSED = {"country_code": len(nouns.COUNTRY_CODE), "extension": len(nouns.EXTENSION), "mime": len(nouns.MIME), "method": len(nouns.METHOD), "currency": len(nouns.CURRENCY), "locale": len(nouns.LOCALE), "timezone": len(nouns.TIMEZONE), "color": len(nouns.COLOR), "phone": 100, "ip": 762}


class Refused(ValueError):
    """Why a table's rows cannot be shown to satisfy its constraints."""


def _local(rows: list[tuple], *names: str) -> DataFrame:
    """A few texts as a local relation: projections of it need no job."""
    return SparkSession.active().createDataFrame(pa.table({n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(names)}))


def readings(texts: Iterable[str]) -> None:
    """Read check texts that are not known yet: one projection of all of them."""
    if new := sorted(set(texts) - _CHECKS.keys()):
        read = F.transform(shapes.conjuncts(F.col("text")), lambda part: shapes.obligation(part))
        for r in _local([(t,) for t in new], "text").select("text", read.alias("r")).collect():  # a row a text
            _CHECKS[r["text"]] = r["r"]


def meanings(catalog: Catalog) -> None:
    """Read the names of columns that are not known yet: noun, range and time band."""
    if new := sorted({(t.name, f.name) for t in catalog.values() for f in t.fields} - _NAMES.keys()):
        for r in _local(new, "t", "c").select("t", "c", nouns.noun_of(F.col("t"), F.col("c")).alias("noun"), nouns.range_of(F.col("c")).alias("range"), nouns.moment_of(F.col("c")).alias("band")).collect():
            _NAMES[r["t"], r["c"]] = r


def bound(catalog: Catalog) -> Catalog:
    """The catalog with what indexes, triggers and partitions ask for as keys, checks and reasons to refuse.

    A unique index is a key, one in lower case a key of lowered values; a list
    partition without a default is a value set. A trigger that may raise, or sets
    a column that rows give, refuses its table; one that writes elsewhere refuses
    the tables written, or its own where these are partitioned or not in the
    catalog. What is not read refuses as well.
    """
    if not any(t.indexes or t.triggers or t.partition for t in catalog.values()):
        return catalog
    facts = frames(SparkSession.active(), catalog)
    out = {n: replace(t, indexes=(), triggers=(), partition=None) for n, t in catalog.items()}
    plain = {n.lower(): n for n in catalog}

    def add(name: str, **more: tuple) -> None:
        out[name] = replace(out[name], **{k: getattr(out[name], k) + v for k, v in more.items()})

    names = F.regexp_extract("definition", r"(?i)\bINDEX\s+(?:IF NOT EXISTS\s+)?\"?(\w+)", 1)
    for r in facts["indexes"].select("table_name", names.alias("name"), shapes.index(F.col("definition")).alias("r")).orderBy("table_name", "name").collect():
        key, have = tuple((r["r"]["columns"] or "").split(",")), {f.name for f in catalog[r["table_name"]].fields}
        if r["r"]["reading"] == "unknown" or (r["r"]["reading"] != "harmless" and not set(key) <= have):
            add(r["table_name"], opaque=(f"index {r['name']} is not read",))
        elif r["r"]["reading"] != "harmless":
            add(r["table_name"], unique=() if key in out[r["table_name"]].keys else (key,), checks=((r["name"], f"{key[0]} = lower({key[0]})"),) if r["r"]["reading"] == "lowered" else ())
    for r in facts["partitions"].select("table_name", shapes.partition(F.col("partition_key"), F.col("bounds")).alias("r")).collect():
        if r["r"]["reading"] == "one_of":
            add(r["table_name"], checks=(("partition", f"{r['r']['column_name']} IN (" + ", ".join(f"'{v}'" for v in r["r"]["items"]) + ")"),))
        elif r["r"]["reading"] == "unknown":
            add(r["table_name"], opaque=("its partitions are not read",))
    for r in facts["triggers"].select("table_name", "trigger_name", shapes.trigger(F.col("body")).alias("r")).orderBy("table_name", "trigger_name").collect():
        name, found = r["table_name"], r["r"]
        set_ = {c for c in found["assigns"].split(",") if c} & {f.name.lower() for f in catalog[name].written()}
        if found["raises"] or set_:
            add(name, opaque=(f"trigger {r['trigger_name']} may raise" if found["raises"] else f"trigger {r['trigger_name']} sets {min(set_)}",))
        for target in (t for t in found["targets"].split(",") if t):
            known = plain.get(target)
            add(known if known and not catalog[known].partition else name, opaque=(f"trigger {r['trigger_name']} writes {target}",))
    return out


#: Which readings of a check suit which types.
_SUITS = {
    **dict.fromkeys(("lower_bound", "upper_bound"), (*types.LIMITS, "numeric", "real", "double")),
    **dict.fromkeys(("length_limit", "min_length", "non_empty", "lowercase"), types.TEXTS),
    **dict.fromkeys(("byte_length", "byte_limit"), (*types.TEXTS, "bytea")),
    "json_type": ("json", "jsonb"),
    "value_set": (*types.TEXTS, *types.LIMITS, "numeric", "real", "double", "boolean", "date", "timestamp", "timestamptz", "enum", "uuid"),
}


def obliged(table: Table, lost: Collection[str] = ()) -> dict[str, Bounds]:
    """The obligations of each column from its type and all checks; raises :class:`Refused` where one is not read or they conflict.

    ``lost`` names the tables that have no row to refer to when this one is
    made. Of a group of which exactly one column has a value, the first one that
    is sure to get it carries it.
    """
    if table.opaque:
        raise Refused(table.opaque[0])
    kinds = {f.name: table.kind(f.name) for f in table.fields}
    out: dict[str, Bounds] = {f.name: Bounds() for f in table.fields}
    needed = {f.name for f in table.written()}
    for f in table.fields:
        if not kinds[f.name].known:
            if not f.nullable and f.name in needed:
                raise Refused(f"{f.name} has the type {f.type}, which is not known")
            out[f.name] = Bounds(must_be_null=True)
        elif kinds[f.name].element.length is not None:
            out[f.name] = out[f.name].tightened(max_length=kinds[f.name].element.length)
    inner = [(f"of the type of {f.name}", re.sub(r"\bVALUE\b", f.name, text), f.name) for f in table.fields for text in kinds[f.name].element.checks + kinds[f.name].checks]
    texts = [*inner, *((name, text, None) for name, text in table.checks)]
    readings(text for _, text, _ in texts)
    unsure = {c for r in table.references for c in r.columns if r.table in lost or r.table == table.name}
    groups: list[tuple[str, str, list[str]]] = []
    for name, text, element in texts:
        for r in _CHECKS[text]:
            column, n, meaning = r["column_name"], r["bound"], r["meaning"]
            touched = set(r["names"] or ()) | ({column} if column else set())
            if meaning == "unknown" or not touched <= out.keys():
                raise Refused(f"check {name} is not read")
            if meaning in _SUITS and (kinds[column].element if element else kinds[column]).name not in _SUITS[meaning] or meaning == "cardinality_limit" and not kinds[column].of:
                raise Refused(f"check {name} does not suit the type of {column}")
            more = {
                "value_set": lambda: {"values": tuple(r["literals"])}, "lowercase": lambda: {"lower": True}, "byte_length": lambda: {"exact_bytes": n}, "byte_limit": lambda: {"max_length": n}, "length_limit": lambda: {"max_length": n},
                "min_length": lambda: {"min_length": n}, "non_empty": lambda: {"min_length": 1}, "lower_bound": lambda: {"floor": n}, "upper_bound": lambda: {"ceiling": n}, "json_type": lambda: {"json_kind": r["kind"]}, "must_be_null": lambda: {"must_be_null": True},
            }.get(meaning)
            if more:
                clash = meaning in ("byte_length", "json_type") and {"byte_length": out[column].exact_bytes, "json_type": out[column].json_kind}[meaning] not in (None, *more().values())
                if clash:
                    raise Refused(f"checks on {column} leave no value")
                out[column] = out[column].tightened(**more())
            else:
                groups.append((meaning, name, list(r["names"] or ()) or [column]))
    for meaning, name, names in groups:
        if meaning == "exactly_one":
            sure = [c for c in names if c not in unsure and not out[c].must_be_null]
            if not sure:
                raise Refused(f"check {name} has no column that is sure to have a value")
            for other in names:
                if other != sure[0]:
                    out[other] = out[other].tightened(must_be_null=True)
    for meaning, name, names in groups:
        valued = [c for c in names if not out[c].must_be_null and c not in unsure]
        enough = {"exactly_one": len(valued) == 1, "at_least_one": bool(valued), "cardinality_limit": True}.get(meaning, len(valued) == len(names))
        if not enough:
            raise Refused(f"check {name} asks for a value where there may be none")
    for f in table.fields:
        out[f.name] = fitted(f, kinds[f.name].element, out[f.name])
    return out


def converted(kind: types.Kind, value: str) -> bool:
    """Is the text a value of the type, with nothing lost?"""
    try:
        if kind.name in types.LIMITS:
            low, high = types.LIMITS[kind.name]
            return low <= int(value) <= high
        if kind.name == "numeric":
            scale, number = kind.scale if kind.scale is not None else 2, Decimal(value)
            return number == round(number, scale) and abs(number) < Decimal(10) ** ((kind.precision or 18) - scale)
        if kind.name in ("real", "double"):
            return math.isfinite(float(value)) and (kind.name == "double" or float(value) == int(float(value)) and abs(float(value)) <= 1 << 24)
        if kind.name == "boolean":
            return value.lower() in ("true", "false")
        if kind.name == "date":
            return bool(datetime.date.fromisoformat(value))
        if kind.name in ("timestamp", "timestamptz"):
            return datetime.datetime.fromisoformat(value).tzinfo is None
        return kind.name != "enum" or value in kind.labels
    except (ValueError, ArithmeticError):
        return False


def fitted(f: Field, kind: types.Kind, b: Bounds) -> Bounds:
    """Bounds whose values fit their type, lengths and limits; raises where nothing is left."""
    if b.must_be_null:
        if not f.nullable:
            raise Refused(f"{f.name} must be null and must not")
        return b
    if b.values is not None:
        fit = tuple(v for v in dict.fromkeys(b.values) if converted(kind, v))
        if kind.name in types.TEXTS:
            fit = tuple(v for v in fit if (b.max_length is None or len(v.encode()) <= b.max_length) and (b.min_length is None or len(v) >= b.min_length) and (not b.lower or v == v.lower()) and (b.exact_bytes in (None, len(v.encode()))))
        if b.floor is not None or b.ceiling is not None:
            fit = tuple(v for v in fit if (b.floor is None or Decimal(v) >= b.floor) and (b.ceiling is None or Decimal(v) <= b.ceiling))
        b = replace(b, values=fit)
    most = b.max_length if b.max_length is not None else 4_096
    lengths = (b.min_length or 0) > most or (b.exact_bytes is not None and not (b.min_length or 0) <= b.exact_bytes <= most)
    if b.values == () or lengths or (b.floor is not None and b.ceiling is not None and b.floor > b.ceiling):
        raise Refused(f"checks on {f.name} leave no value")
    if b.values is None and kind.name in _NUMBERS and numbers(kind, b) is None:
        raise Refused(f"checks on {f.name} leave no value of its type")
    return b


_NUMBERS = (*types.LIMITS, "numeric", "real", "double")


def numbers(kind: types.Kind, b: Bounds, unique: bool = False) -> tuple[int, int, int] | None:
    """(unit, low, high): the values low / unit to high / unit that a column of numbers takes; None if there is none.

    What the type holds exactly limits them; without a floor, values go down from
    a ceiling that is too low for the usual ones.
    """
    asked = [abs(x) for x in (b.floor, b.ceiling) if x is not None]
    if kind.name in types.LIMITS:
        unit, (least, most) = 1, types.LIMITS[kind.name]
        span = cells.INTEGER_CAPS[{"smallint": 2, "int": 4, "bigint": 8}[kind.name]]
        span = span if unique else min(span, 1_000_000)
    elif kind.name == "numeric":
        unit = 10 ** (kind.scale if kind.scale is not None else 2)
        most = 10 ** min(kind.precision or 18, 18) - 1
        least, span = -most, 10_000 * unit + 1
    else:
        bits = 24 if kind.name == "real" else 53
        unit = 10_000 if (max(asked, default=0) + 1_000) * 10_000 <= 1 << bits else 1
        most = 1 << bits
        least, span = -most, 1_000 * unit
    low = None if b.floor is None else b.floor * unit
    high = None if b.ceiling is None else b.ceiling * unit
    usual = 1 if unique and unit == 1 else 0
    if low is None:
        low = usual if high is None or high >= usual else high - span + 1
    low = max(low, least)
    high = min(most, low + span - 1 if high is None else min(high, low + (1 << 62)))
    return (unit, low, high) if low <= high else None


def supplied(narrow: Reference, wide: Reference, catalog: Catalog) -> bool:
    """Does the row that ``wide`` refers to satisfy ``narrow`` as well? Its table must refer on with the very columns."""
    if wide.table not in catalog or not set(narrow.columns) <= set(wide.columns):
        return False
    there = tuple(wide.keys[wide.columns.index(c)] for c in narrow.columns)
    return any(r.table == narrow.table and r.columns == there and r.keys == narrow.keys for r in catalog[wide.table].references)


def leading(table: Table, catalog: Catalog) -> tuple[Reference, ...]:
    """The references that rows are drawn by; the others are repeated or supplied by these.

    Raises :class:`Refused` where two references share a column and no row of
    one parent is sure to satisfy both.
    """
    kept: list[Reference] = []
    for r in table.references:
        if not any(r == k or supplied(r, k, catalog) for k in kept):
            kept = [k for k in kept if not supplied(k, r, catalog)] + [r]
    for i, a in enumerate(kept):
        for b in kept[i + 1 :]:
            if both := [c for c in a.columns if c in b.columns]:
                raise Refused(f"its references to {a.table} and {b.table} share {both[0]}")
    return tuple(kept)


def source(catalog: Catalog, table: str, column: str) -> tuple[str, str] | None:
    """The table and column whose expression a column's values come from; None round a cycle."""
    seen = set()
    while (table, column) not in seen:
        seen.add((table, column))
        ref = next((r for r in catalog[table].references if column in r.columns and r.table in catalog), None)
        if ref is None:
            return table, column
        table, column = ref.table, ref.keys[ref.columns.index(column)]
    return None


def implied(catalog: Catalog, table: Table, column: str, child: Bounds, parents: Mapping[str, dict[str, Bounds]]) -> bool:
    """Do the values that a reference's column takes satisfy what is asked of the column itself?"""
    if child.must_be_null:
        return True
    at = source(catalog, table.name, column)
    plain = child == Bounds()
    if at is None or at[0] not in parents:
        return plain
    kind, own, b = catalog[at[0]].kind(at[1]), table.kind(column), parents[at[0]][at[1]]
    if own.name in types.LIMITS and kind.name in types.LIMITS or child.floor is not None or child.ceiling is not None:
        span = (1, 1, types.LIMITS[kind.name][1]) if catalog[at[0]].field_of(at[1]).sequence and kind.name in types.LIMITS else numbers(kind, b, True) if kind.name in _NUMBERS and b.values is None else None
        if b.values is not None:
            ends = [Decimal(v) for v in b.values] if kind.name in _NUMBERS else []
        else:
            ends = [Decimal(span[1]) / span[0], Decimal(span[2]) / span[0]] if span else []
        low, high = types.LIMITS.get(own.name, (None, None))
        low = max((x for x in (low, child.floor) if x is not None), default=None)
        high = min((x for x in (high, child.ceiling) if x is not None), default=None)
        if not ends or (low is not None and min(ends) < low) or (high is not None and max(ends) > high and not (child.ceiling is None and kind.name in types.LIMITS and b.ceiling is None)):
            return False
    most = b.max_length if b.max_length is not None else b.exact_bytes
    return (
        (child.max_length is None or (most is not None and most <= child.max_length) or (b.values is not None and all(len(v) <= child.max_length for v in b.values)))
        and (child.min_length is None or (b.min_length or b.exact_bytes or 0) >= child.min_length)
        and child.exact_bytes in (None, b.exact_bytes)
        and (not child.lower or b.lower)
        and (child.values is None or (b.values is not None and set(b.values) <= set(child.values)))
        and child.json_kind in (None, b.json_kind)
    )


def judged(catalog: Catalog) -> tuple[dict[str, str], dict[str, dict[str, Bounds]], dict[str, frozenset[str]]]:
    """Refused tables with reasons, the obligations of the others, and what each can't refer to when its rows are made."""
    readings(text for t in catalog.values() for _, text in t.checks)
    ordered = order(catalog)
    place = {n: i for i, n in enumerate(ordered)}
    waiting = {n: [r.table for r in t.references if r.table != n and not t.optional(r)] for n, t in sorted(catalog.items())}
    out: dict[str, str] = {}
    while True:
        lost = {n: frozenset(r.table for r in t.references if r.table in out or place.get(r.table, len(place)) >= place.get(n, -1)) for n, t in catalog.items()}
        found: dict[str, dict[str, Bounds]] = {}
        new: dict[str, str] = {}
        for name, t in sorted(catalog.items()):
            if name in out:
                continue
            try:
                found[name] = obliged(t, lost[name])
                leading(t, catalog)
            except Refused as why:
                new[name] = str(why)
        for name in found:
            t = catalog[name]
            bad = [c for r in t.references for c in r.columns if r.table in catalog and r.table not in out and not implied(catalog, t, c, found[name][c], found)]
            if name not in new and bad:
                new[name] = f"checks or the type of {bad[0]} may not hold for what it refers to"
            elif name not in new and (unread := [p for p in waiting[name] if p not in catalog]):
                new[name] = f"needs {unread[0]}, which is not in the catalog"
            elif name not in new and name in place:
                late = [r for r in t.references if place.get(r.table, -1) > place[name] and not t.optional(r) and any(set(r.columns) & set(k) for k in t.keys)]
                if late:
                    new[name] = f"has a key with its reference to {late[0].table}, which refers back"
        if not new:
            new = {n: f"needs {bad[0]}, which is refused" for n in sorted(catalog) if n not in out and (bad := [p for p in waiting[n] if p in out])}
        if not new:
            break
        out |= new
    out |= {n: "in or above a cycle of required references" for n in sorted(catalog) if n not in ordered and n not in out}
    return out, {n: b for n, b in found.items() if n not in out}, lost


def refusals(catalog: Catalog) -> dict[str, str]:
    """The tables that cannot be filled, and why."""
    return judged(bound(catalog))[0]


def domain(kind: types.Kind, bounds: Bounds, sequence: bool = False) -> int | None:
    """How many different values the expression of a keyed column takes before one comes back; None if there are enough for any table."""
    if bounds.must_be_null:
        return None
    if kind.of:
        return domain(kind.of, bounds)
    if sequence:
        return types.LIMITS[kind.name][1] if kind.name in types.LIMITS else None
    if bounds.values is not None:
        return len(bounds.values)
    if kind.name in _NUMBERS:
        _, low, high = numbers(kind, bounds, True)
        return high - low + 1
    if kind.name in types.TEXTS:
        limit = min(x for x in (bounds.max_length, bounds.exact_bytes, 4_096) if x is not None)
        return 36**limit if limit <= 8 else 36 ** (limit - 1) if limit < 13 else None
    if kind.name == "bytea":
        return 256 ** min(7, octets(bounds))
    if kind.name in ("json", "jsonb"):
        return {"boolean": 2, "null": 1}.get(bounds.json_kind)
    fixed = {"boolean": 2, "enum": len(set(kind.labels)), "date": cells.EPOCH_DAYS, "time": 86_400, "timestamp": cells.EPOCH_SECONDS, "timestamptz": cells.EPOCH_SECONDS, "interval": 90, "cidr": 1 << 16, "macaddr": 1 << 24, "inet": 1 << 24}
    return fixed.get(kind.name)


def octets(bounds: Bounds) -> int:
    """How many bytes a binary column's values have."""
    return bounds.exact_bytes if bounds.exact_bytes is not None else max(bounds.min_length or 0, min(7, bounds.max_length if bounds.max_length is not None else 7))


def order(catalog: Catalog) -> list[str]:
    """Parents before children, by name within a level.

    Where a cycle is left, optional references in it do not count (they are
    filled in afterwards); where all required references of a cycle can be
    checked at the end, its tables follow each other by name. Other cycles, and
    what needs them, are left out. Tables outside the catalog are not waited for.
    """
    done: list[str] = []
    every = {n: {r.table for r in t.references} & catalog.keys() - {n} for n, t in catalog.items()}
    needed = {n: {r.table for r in t.references if not t.optional(r)} & catalog.keys() - {n} for n, t in catalog.items()}
    waits = {n: {r.table for r in t.references if not t.optional(r) and not r.deferrable} & catalog.keys() - {n} for n, t in catalog.items()}
    while len(done) < len(catalog):
        open_, have = sorted(catalog.keys() - set(done)), set(done)
        ready = [n for n in open_ if every[n] <= have]
        if not ready:
            ways = _reached(every, open_)
            ready = [n for n in open_ if needed[n] <= have and all(n in ways[p] for p in ways[n])]
        if not ready:
            ways = _reached(needed, open_)
            ready = next((sorted(ways[n]) for n in open_ if n in ways[n] and all(ways[m] == ways[n] and not waits[m] & ways[n] for m in ways[n])), None) or [n for n in open_ if needed[n] <= have]
        if not ready:
            break
        done += ready
    return done


def _reached(edges: Mapping[str, Collection[str]], among: Collection[str]) -> dict[str, set[str]]:
    """What each table comes to along the edges without leaving ``among``."""
    out: dict[str, set[str]] = {}
    for start in among:
        seen: set[str] = set()
        front = set(edges[start]) & set(among)
        while front:
            seen |= front
            front = {p for n in front for p in edges[n] if p in among} - seen
        out[start] = seen
    return out


def key_capacity(table: Table, key: tuple[str, ...], rows: Mapping[str, int], bounds: Mapping[str, Bounds]) -> int | None:
    """The product of the choices of a key: a reference in it counts once, as its parent's rows."""
    left, product = set(key), 1
    for ref in sorted(table.references, key=lambda r: -len(r.columns)):
        if set(ref.columns) <= left and ref.table in rows:
            left -= set(ref.columns)
            product *= rows[ref.table]
    if any(r.table == table.name and set(r.columns) & left for r in table.references):
        return product  # all rows refer to one
    for c in left:
        size = domain(table.kind(c), bounds[c], table.field_of(c).sequence)
        if size is None:
            return None
        product *= size
    return product


def sizes(catalog: Catalog, asked: Mapping[str, int], default: int = 50) -> dict[str, int]:
    """Rows of each table: what is asked for, less if a unique key has fewer values; caps travel to children."""
    rows: dict[str, int] = {}
    catalog = bound(catalog)
    refused, obligations, _ = judged(catalog)
    for name in order(catalog):
        if name in refused:
            continue
        t, bounds = replace(catalog[name], references=leading(catalog[name], catalog)), obligations[name]
        caps = [c for key in t.keys if (c := key_capacity(t, key, rows, bounds)) is not None]
        proved = [c for c in strided(t, rows, bounds)[1].values() if c is not None]
        widths = [types.LIMITS[t.kind(f.name).name][1] for f in t.fields if f.sequence and t.kind(f.name).name in types.LIMITS]
        rows[name] = min([asked.get(name, default), *caps, *proved, *widths])
    return rows


@dataclass(frozen=True)
class Plan:
    """One table: its rows, and an expression for each column over ``id``."""

    table: Table
    rows: int
    columns: dict[str, Callable[[Column], Column]]
    #: The row of the table at the top of its chain of references that a row belongs to, and how far down the table is.
    identity: Callable[[Column], Column] = lambda row: row
    depth: int = 0

    def frame(self, spark: SparkSession, partitions: int | None = None) -> DataFrame:
        base = spark.range(0, self.rows, 1, partitions) if partitions else spark.range(self.rows)
        return base.select(*[make(F.col("id")).alias(name) for name, make in self.columns.items()])


def _value(table: Table, f: Field, kind: types.Kind, bounds: Bounds, seed: int, stride: int, unique: bool, identity: Callable[[Column], Column], depth: int) -> Callable[[Column], Column]:
    """The expression of a column that is no reference."""
    head = f.name.split("_")[0] if f.name.isascii() else "v"
    named = _NAMES.get((table.name, f.name))
    if bounds.must_be_null:
        return lambda row: F.lit(None).cast(kind.spark)
    if kind.of:
        one = _value(table, f, kind.of, bounds, seed, stride, unique, identity, depth)
        return lambda row: F.array(one(row))
    free = not unique and bounds.values is None and bounds.floor is None and bounds.ceiling is None
    if named and named["range"] and free and kind.name in _NUMBERS:
        ranged = replace(bounds, floor=named["range"]["low"], ceiling=named["range"]["high"])
        bounds = ranged if numbers(kind, ranged) else bounds

    def realistic(row: Column) -> Column | None:
        """What the column's name asks for, where its constraints leave room for that."""
        if not named or bounds.lower or bounds.min_length or bounds.exact_bytes:
            return None
        noun = "country_code" if named["noun"] == "country" and bounds.max_length == 2 else named["noun"]
        if noun is None or (unique and (noun in _CLOSED or (bounds.max_length or 128) < 128)):
            return None
        whose = cells.step(row, stride) if unique else identity(row)
        return nouns.noun(noun, F.pmod(whose, F.lit(_CLOSED[noun])) if noun in _CLOSED else whose)

    def make(row: Column) -> Column:
        number = cells.step(row, stride) if unique else cells.cell(seed, table.name, f.name, row)
        if bounds.values is not None:
            return cells.chosen(number, list(bounds.values)).cast(kind.spark)
        if named and named["band"] and not unique and kind.name in ("timestamptz", "timestamp", "date"):
            at = cells.timestamp(nouns.moment(identity(row), cells.cell(seed, table.name, f.name, row), named["band"], depth))
            return at.cast("date") if kind.name == "date" else at
        if f.sequence:
            return (row + 1).cast(kind.spark)
        if kind.name in _NUMBERS:
            unit, low, high = numbers(kind, bounds, unique)
            whole = cells.between(number, low, high)
            return whole.cast(kind.spark) if kind.name in types.LIMITS else (whole.cast("decimal(38,0)") / F.lit(unit)).cast(kind.spark) if kind.name == "numeric" else (whole / F.lit(float(unit))).cast(kind.spark)
        makers = {
            "boolean": lambda: cells.boolean(number), "uuid": lambda: cells.uuid(cells.cell(seed, table.name, f.name, row), row if unique else number), "date": lambda: cells.date(number), "time": lambda: cells.time(number),
            "timestamptz": lambda: cells.timestamp(F.pmod(number, F.lit(cells.EPOCH_SECONDS))), "timestamp": lambda: cells.timestamp(F.pmod(number, F.lit(cells.EPOCH_SECONDS))), "interval": lambda: cells.interval_days(number),
            "jsonb": lambda: cells.json(number, bounds.json_kind or "object"), "json": lambda: cells.json(number, bounds.json_kind or "object"), "bytea": lambda: cells.octet_text(number, octets(bounds)),
            "inet": lambda: cells.inet(number), "cidr": lambda: cells.cidr(number), "macaddr": lambda: cells.macaddr(number), "enum": lambda: cells.chosen(number, list(dict.fromkeys(kind.labels))),
        }
        if kind.name in makers:
            return makers[kind.name]()
        plain = cells.text(head, number if unique else F.pmod(number, F.lit(46_656)), bounds, unique)
        if (made := realistic(row)) is None:
            return plain
        return made if unique or bounds.max_length is None else F.when(F.char_length(made) <= bounds.max_length, made).otherwise(plain)

    return make


def plans(catalog: Catalog, rows: Mapping[str, int], seed: int = 1) -> dict[str, Plan]:
    """A plan for each table that has rows, parents first.

    A table with one reference belongs to what its parent belongs to: persons
    and moments of its rows are those of the row at the top of the chain, which
    the composed row numbers give without a join.
    """
    out: dict[str, Plan] = {}
    catalog = bound(catalog)
    meanings(catalog)
    _, obligations, _ = judged(catalog)
    for name in [n for n in order(catalog) if n in rows and n in obligations]:
        t, bounds = replace(catalog[name], references=leading(catalog[name], catalog)), obligations[name]
        columns: dict[str, Callable[[Column], Column]] = {}
        steps = key_strides(t, rows, bounds)
        identity, depth = (lambda row: row), 0
        if len(catalog[name].references) == 1 and (ref := t.references[0]).table in out and out[ref.table].rows and not any(bounds[c].must_be_null for c in ref.columns):
            identity, depth = _belongs(out[ref.table], steps.get(ref.columns[0], 1)), out[ref.table].depth + 1
        for f in t.fields:
            ref = next((r for r in t.references if f.name in r.columns), None)
            keyed = any(f.name in k for k in t.keys)
            if ref is None:
                columns[f.name] = _value(t, f, t.kind(f.name), bounds[f.name], seed, steps.get(f.name, 1), keyed, identity, depth)
            elif any(bounds[c].must_be_null for c in ref.columns):
                columns[f.name] = lambda row, kind=t.kind(f.name): F.lit(None).cast(kind.spark)
            elif ref.table == name:
                columns[f.name] = _rooted(lambda columns=columns: columns, ref, f.name, 0 if t.optional(ref) else -1)
            elif not rows.get(ref.table) or (ref.table not in out and t.optional(ref) and any(set(ref.columns) & set(k) for k in t.keys)):
                columns[f.name] = lambda row, kind=t.kind(f.name): F.lit(None).cast(kind.spark)
            elif ref.table not in out and t.optional(ref):  # a cycle: one row without, all others refer to the first
                columns[f.name] = _rooted(lambda ref=ref: out[ref.table].columns, ref, f.name)
            else:
                columns[f.name] = _drawn(lambda ref=ref: out[ref.table], ref, f.name, steps.get(f.name, 1))
        out[name] = Plan(t, rows[name], columns, identity, depth)
    return out


def _belongs(parent: Plan, stride: int) -> Callable[[Column], Column]:
    return lambda row: parent.identity(parent_row(row, parent.rows, stride))


def strided(table: Table, rows: Mapping[str, int], bounds: Mapping[str, Bounds]) -> tuple[dict[str, int], dict[tuple[str, ...], int | None]]:
    """The stride of each keyed column, and for how many rows each composite key is proved not to repeat (None: any).

    Wheels whose strides are the product of the sizes before them are an
    odometer. Columns that are a key by themselves count by one and make every
    key with them distinct. Keys that share columns keep the strides given
    already, and only the wheels that go on from there count as proof.
    """
    out: dict[str, int] = {k[0]: 1 for k in table.keys if len(k) == 1}
    proved: dict[tuple[str, ...], int | None] = {}
    for key in sorted((k for k in table.keys if len(k) > 1), key=lambda k: table.keys.index(k)):
        wheels: list[tuple[tuple[str, ...], int | None]] = []
        for c in key:
            ref = next((r for r in table.references if c in r.columns and r.table in rows), None)
            own = any(c in r.columns and r.table == table.name for r in table.references)
            if ref is not None and any(c in w for w, _ in wheels):
                continue
            wheels.append((ref.columns, rows[ref.table]) if ref else ((c,), 1) if own else ((c,), domain(table.kind(c), bounds[c], table.field_of(c).sequence)))
        single = any((c,) in table.keys for c in key)
        # A column without a bound tells all rows apart by itself where it counts by one.
        if single or any(n is None and out.get(w[0], 1) == 1 for w, n in wheels):
            proved[key] = None
            for w, _ in wheels:
                for c in w:
                    out.setdefault(c, 1)
            continue
        cover = 1
        for w, n in sorted((x for x in wheels if x[0][0] in out), key=lambda x: out[x[0][0]]):
            cover *= n if out[w[0]] == cover and n is not None else 1
        for w, n in (x for x in wheels if x[0][0] not in out):
            out |= dict.fromkeys(w, cover)
            cover *= max(1, n or 1)
        proved[key] = cover
    return out, proved


def key_strides(table: Table, rows: Mapping[str, int], bounds: Mapping[str, Bounds]) -> dict[str, int]:
    """The stride of each keyed column, so that the columns of each key together do not repeat."""
    return strided(table, rows, bounds)[0]


def _drawn(parent: Callable[[], Plan], ref: Reference, column: str, stride: int) -> Callable[[Column], Column]:
    """The parent's key; its plan may be made later."""
    key = ref.keys[ref.columns.index(column)]
    return lambda row: parent().columns[key](parent_row(row, parent().rows, stride))


def _rooted(columns: Callable[[], dict[str, Callable[[Column], Column]]], ref: Reference, column: str, root: int = 0) -> Callable[[Column], Column]:
    """The key of the first row, in all rows after the root; a reference that must not be null has no root (-1)."""
    key = ref.keys[ref.columns.index(column)]
    return lambda row: F.when(row > root, columns()[key](F.lit(0).cast("long")))


def selected(catalog: Catalog, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Catalog:
    """The part of a catalog that patterns name, with the parents it needs; what is excluded stays out.

    Indexes, triggers and partitions are read in the whole catalog before. A
    child of an excluded parent is refused, or has no reference if it may.
    """
    spark, catalog = SparkSession.active(), bound(catalog)
    facts = frames(spark, catalog)
    how = graph.selection(facts["tables"], graph.edges(facts["references"], facts["tables"]), spark.createDataFrame([(p,) for p in include], "pattern string"), spark.createDataFrame([(p,) for p in exclude], "pattern string"))
    kept = {r["table_name"] for r in how.collect()}  # names of a catalog
    return {n: t for n, t in catalog.items() if n in kept}


def generate(spark: SparkSession, catalog: Catalog, asked: Mapping[str, int], seed: int = 1) -> dict[str, DataFrame]:
    """The tables that can be filled, parents first."""
    catalog = bound(catalog)
    made = [(n, p) for n, p in plans(catalog, sizes(catalog, asked), seed).items() if p.rows]
    with ThreadPool(8) as pool:  # expressions are put together by many small calls to the JVM
        return dict(zip((n for n, _ in made), pool.map(lambda x: x[1].frame(spark), made), strict=True))


def probe(tables: Mapping[str, DataFrame], catalog: Catalog) -> dict[str, dict[str, int]]:
    """Offer candidate tables to the validator in order; what it says of each that breaks a rule.

    ``tables`` are in dependency order. A table with violations is not kept, and
    children are held against kept parents only.
    """
    said: dict[str, dict[str, int]] = {}
    kept: dict[str, DataFrame] = {}
    for name, df in tables.items():
        t = catalog[name]
        counts = {f"check:{n}": F.sum(failed(p).cast("int")) for n, p in t.checks} | {f"notnull:{f.name}": F.sum(F.col(f.name).isNull().cast("int")) for f in t.fields if not f.nullable and f.name in df.columns}
        broken = {k: v for k, v in df.agg(*[F.coalesce(c, F.lit(0)).alias(k) for k, c in counts.items()]).first().asDict().items() if v} if counts else {}
        broken |= {f"unique:{','.join(k)}": n for k in t.keys if (n := duplicates(df, k).count())}
        for r in t.references:
            if r.table != name:
                n = orphans(df, r, kept[r.table]).count() if r.table in kept else df.where(" and ".join(f"`{c}` is not null" for c in r.columns)).count()
                broken |= {f"reference:{','.join(r.columns)}": n} if n else {}
        if broken:
            said[name] = broken
        else:
            kept[name] = df
    return said
