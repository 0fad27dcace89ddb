"""Column types of a catalog as trees: scalars with length, precision or labels, domains, arrays of any depth.

One reading of a type serves the generator (which Spark type, how wide), the
refusals (what is not known) and the validator (does a value fit).
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Catalog names and others in use for the same type.
NAMES = {
    "bool": "boolean", "boolean": "boolean", "int2": "smallint", "smallint": "smallint", "int": "int", "int4": "int", "integer": "int", "bigint": "bigint", "int8": "bigint", "long": "bigint", "numeric": "numeric", "decimal": "numeric", "real": "real", "float4": "real", "float": "real", "double": "double", "float8": "double",
    "text": "text", "string": "text", "citext": "text", "name": "text", "varchar": "varchar", "char": "char", "bpchar": "char", "uuid": "uuid", "date": "date", "time": "time", "timetz": "time", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "timestamptz": "timestamptz", "interval": "interval",
    "json": "json", "jsonb": "jsonb", "bytea": "bytea", "binary": "bytea", "inet": "inet", "cidr": "cidr", "macaddr": "macaddr",
}
SPARK = {
    "boolean": "boolean", "smallint": "smallint", "int": "int", "bigint": "bigint", "real": "float", "double": "double", "text": "string", "varchar": "string", "char": "string", "enum": "string", "uuid": "string", "date": "date", "time": "string", "timestamp": "timestamp_ntz", "timestamptz": "timestamp_ntz",
    "interval": "interval day to second", "json": "string", "jsonb": "string", "bytea": "binary", "inet": "string", "cidr": "string", "macaddr": "string", "unknown": "string",
}
LIMITS = {"smallint": (-(1 << 15), (1 << 15) - 1), "int": (-(1 << 31), (1 << 31) - 1), "bigint": (-(1 << 63), (1 << 63) - 1)}
TEXTS = ("text", "varchar", "char")
#: Domains that catalogs use: name -> (base type, checks on VALUE).
Domains = Mapping[str, tuple[str, tuple[str, ...]]]


@dataclass(frozen=True)
class Kind:
    """A type. ``name`` is the canonical scalar, ``enum``, ``array`` or ``unknown``; a domain is its base type with ``checks``."""

    name: str
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    labels: tuple[str, ...] = ()
    of: Kind | None = None
    checks: tuple[str, ...] = ()

    @property
    def known(self) -> bool:
        return self.of.known if self.of else self.name != "unknown"

    @property
    def spark(self) -> str:
        if self.of:
            return f"array<{self.of.spark}>"
        if self.name == "numeric":
            return f"decimal({min(38, self.precision or 18)},{self.scale if self.scale is not None else 2})"
        return SPARK[self.name]

    @property
    def element(self) -> Kind:
        """The scalar inside of all arrays."""
        return self.of.element if self.of else self


def read(text: str, domains: Domains | None = None, seen: frozenset[str] = frozenset()) -> Kind:
    """The type that a text names; ``unknown`` where it does not name one that is known.

    Arrays are written ``type[]`` or ``array<type>``, enumerations
    ``enum(a|b)``. A domain is looked up in ``domains``; its checks, and those of
    domains below it, belong to it. A domain of itself is unknown.
    """
    text = text.strip()
    if m := re.fullmatch(r"(?is)(.*)\[\]|array<(.*)>", text):
        return Kind("array", of=read(m[1] if m[1] is not None else m[2], domains, seen))
    if m := re.fullmatch(r"(?is)enum\((.*)\)", text):
        return Kind("enum", labels=tuple(m[1].split("|")))
    if domains and text in domains and text not in seen:
        base, checks = domains[text]
        kind = read(base, domains, seen | {text})
        return replace(kind, checks=(*kind.checks, *checks))
    m = re.fullmatch(r"(?is)([a-z_0-9]+)(?:\(\s*([0-9]+)\s*(?:,\s*([0-9]+)\s*)?\))?", text)
    name = NAMES.get(m[1].lower()) if m else None
    if name is None or (m[2] and name not in ("varchar", "char", "numeric", "time", "timestamp", "timestamptz")):
        return Kind("unknown")
    if name in ("varchar", "char"):
        return Kind(name, length=int(m[2]) if m[2] else 1 if name == "char" else None)
    if name == "numeric" and m[2]:
        return Kind(name, precision=int(m[2]), scale=int(m[3] or 0))
    return Kind(name)


def _whole(value: Column, low: int, high: int) -> Column:
    # Limits as numbers of 20 digits, so that a value beyond 64 bits is compared and not cut.
    return (value >= F.lit(str(low)).cast("decimal(20,0)")) & (value <= F.lit(str(high)).cast("decimal(20,0)")) & (value == F.floor(value))


def fits(value: Column, held: str, kind: Kind) -> Column:
    """Would the value, held in Spark as ``held``, go into the type? Null for a null value.

    Texts are held against length without the blanks at their end, numbers
    against width, or against precision once they are rounded to the scale;
    texts in other types must read as one. An array fits if all its entries do.
    Nothing fits an unknown type.
    """
    if kind.of:
        if not held.startswith("array<"):
            return F.when(value.isNotNull(), F.lit(False))
        return F.when(value.isNotNull(), F.coalesce(F.forall(value, lambda x: F.coalesce(fits(x, held[6:-1], kind.of), F.lit(True))), F.lit(True)))
    text = held == "string"
    ok: Column
    if kind.name in LIMITS:
        numeric = held in ("tinyint", "smallint", "int", "bigint", "float", "double") or held.startswith("decimal")
        ok = _whole(value.try_cast("decimal(38,10)") if text else value, *LIMITS[kind.name]) if text or numeric else F.lit(False)
    elif kind.name == "numeric":
        number = value.try_cast("double") if text else value.cast("double")
        ok = ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
        if kind.precision is not None:
            ok = ok & (F.abs(F.round(number, kind.scale)) < F.lit(10.0 ** (kind.precision - kind.scale)))
    elif kind.name in ("real", "double"):
        ok = value.try_cast("double").isNotNull()
    elif kind.name in TEXTS:
        ok = (F.char_length(F.rtrim(value.cast("string"))) <= kind.length) if kind.length is not None else F.lit(True)
    elif kind.name == "enum":
        ok = value.cast("string").isin(list(kind.labels))
    elif kind.name in ("date", "timestamp", "timestamptz", "boolean"):
        ok = value.try_cast(SPARK[kind.name]).isNotNull()
    elif kind.name in ("json", "jsonb"):
        ok = F.try_parse_json(value.cast("string")).isNotNull()
    elif kind.name == "uuid":
        ok = value.cast("string").rlike("(?i)^[0-9a-f]{8}-?([0-9a-f]{4}-?){3}[0-9a-f]{12}$")
    elif kind.name == "time":
        ok = value.cast("string").rlike(r"^([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?$")
    elif kind.name == "inet":
        part = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
        ok = value.cast("string").rlike(rf"^{part}(\.{part}){{3}}(/(3[0-2]|[12]?[0-9]))?$")
    elif kind.name == "bytea":
        ok = F.lit(held in ("binary", "string"))
    elif kind.name == "interval":
        ok = F.lit(held.startswith("interval"))
    else:
        ok = F.lit(False)
    return F.when(value.isNotNull(), F.coalesce(ok, F.lit(False)))


def misfits(df, kinds: Mapping[str, Kind]):  # noqa: ANN001, ANN201
    """A row a column that is declared and there: column_name, kind, misfits (values that do not fit), from one pass over the table."""
    held = dict(df.dtypes)
    names = [c for c in kinds if c in held]
    counts = [F.coalesce(F.sum((~fits(F.col(c), held[c], kinds[c])).cast("long")), F.lit(0)).alias(f"m{i}") for i, c in enumerate(names)]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("misfits")) for i, c in enumerate(names)])
    return df.agg(*counts).select(F.explode(rows).alias("r")).select("r.*")
