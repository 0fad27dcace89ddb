"""Values of single cells as column expressions.

A value depends on seed, table, column and row and on nothing else: no running
stream, no partition number. The same rows come out whatever the partitioning,
and adding a table or a column changes nothing elsewhere. All of it stays in
generated code; nothing here is a Python function of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_DAYS = 3_650
EPOCH_SECONDS = 315_360_000
#: Largest spans of drawn whole numbers by width in bytes.
INTEGER_CAPS = {2: 32_000, 4: 2_000_000_000, 8: 4_000_000_000_000}


@dataclass(frozen=True)
class Bounds:
    """What the constraints read ask of a column's values."""

    floor: int | None = None
    ceiling: int | None = None
    max_length: int | None = None
    min_length: int | None = None
    exact_bytes: int | None = None
    lower: bool = False
    values: tuple[str, ...] | None = None
    json_kind: str | None = None
    must_be_null: bool = False

    def tightened(self, **more: object) -> Bounds:
        """The intersection with one more obligation."""
        now = dict(more)
        for name, pick in (("floor", max), ("ceiling", min), ("max_length", min), ("min_length", max)):
            if name in now and getattr(self, name) is not None:
                now[name] = pick(now[name], getattr(self, name))
        if "values" in now and self.values is not None:
            now["values"] = tuple(v for v in self.values if v in now["values"])
        return replace(self, **now)


def cell(seed: int, table: str, column: str, row: Column, draw: int = 0) -> Column:
    """A long from 0 to 2**60 - 1 for the cell: the first 15 hexadecimal digits of an MD5."""
    name = F.concat(F.lit(f"{seed}/{table}/{column}/"), row.cast("string"), F.lit(f"/{draw}" if draw else ""))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def step(row: Column, stride: int) -> Column:
    """The number that a column counts by: it moves on every ``stride`` rows."""
    return F.floor(row / F.lit(stride)).cast("long") if stride != 1 else row.cast("long")


def integer(number: Column, floor: int, span: int) -> Column:
    """``floor`` and up, within ``span`` values; distinct for distinct numbers below the span."""
    return (F.lit(floor) + F.pmod(number, F.lit(span))).cast("long")


def scaled(number: Column, floor: int, ceiling: int, scale: int) -> Column:
    """A decimal drawn in whole units of its last digit, so that it cannot pass the ceiling."""
    unit = 10**scale
    whole = F.lit(floor * unit) + F.pmod(number, F.lit((ceiling - floor) * unit + 1))
    return (whole.cast("decimal(20,0)") / F.lit(unit)).cast(f"decimal(18,{scale})")


def between(number: Column, low: int, high: int) -> Column:
    """A whole number from ``low`` to ``high``, both ends included; distinct for as many numbers on end."""
    return (F.lit(low).cast("long") + F.pmod(number.cast("long"), F.lit(high - low + 1).cast("long"))).cast("long")


def double(number: Column, floor: int = 0, span: int = 1_000) -> Column:
    """Four decimals, from ``floor`` to below ``floor + span``."""
    return (F.lit(floor * 10_000) + F.pmod(number, F.lit(span * 10_000))) / F.lit(10_000.0)


def boolean(number: Column) -> Column:
    return F.pmod(number, F.lit(2)) == 1


def base36(number: Column) -> Column:
    """The shortest base-36 form, in lower case."""
    return F.lower(F.conv(number.cast("string"), 10, 36))


def padded(text: Column, least: int) -> Column:
    """At least so many characters, filled with hyphens."""
    return F.concat(text, F.repeat(F.lit("-"), F.greatest(F.lit(0), F.lit(least) - F.char_length(text))))


def text(head: str, number: Column, bounds: Bounds, unique: bool) -> Column:
    """A word, and the number in base 36 where values must differ, within the lengths allowed."""
    limit = min(x for x in (bounds.max_length, bounds.exact_bytes, 4_096) if x is not None)
    tag = base36(number)
    if not unique:
        out = F.substring(F.concat(F.lit(head + "-"), tag), 1, limit)
    elif limit <= 8:
        out = tag
    else:
        out = F.concat(F.lit(head[: max(0, limit - 14)]), F.lit("-"), tag)
    least = max(bounds.min_length or 0, bounds.exact_bytes or 0)
    out = padded(out, least) if least else out
    return F.lower(out) if bounds.lower else out


def uuid(high: Column, low: Column) -> Column:
    """32 hexadecimal digits in groups: 60 drawn bits and the number itself."""
    digits = F.concat(F.lpad(F.lower(F.hex(high)), 16, "0"), F.lpad(F.lower(F.hex(low)), 16, "0"))
    return F.concat_ws("-", *[F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def date(number: Column) -> Column:
    return F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(number, F.lit(EPOCH_DAYS)).cast("int"))


def time(number: Column) -> Column:
    """HH:mm:ss as a string."""
    s = F.pmod(number, F.lit(86_400))
    part = [F.floor(s / 3_600), F.floor(F.pmod(s, F.lit(3_600)) / 60), F.pmod(s, F.lit(60))]
    return F.concat_ws(":", *[F.lpad(p.cast("string"), 2, "0") for p in part])


def timestamp(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("int"), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))


def interval_days(number: Column) -> Column:
    return F.make_dt_interval((F.lit(1) + F.pmod(number, F.lit(90))).cast("int"))


def json(number: Column, kind: str = "object") -> Column:
    n = number.cast("string")
    forms = {
        "object": F.concat(F.lit('{"n": '), n, F.lit("}")),
        "array": F.concat(F.lit("["), n, F.lit("]")),
        "string": F.concat(F.lit('"v'), n, F.lit('"')),
        "number": n,
        "boolean": F.when(boolean(number), "true").otherwise("false"),
        "null": F.lit("null"),
    }
    return forms[kind]


def octets(number: Column, count: int) -> list[Column]:
    """The low bytes of a number, the lowest last."""
    return [F.pmod(F.floor(number / F.lit(256**i)).cast("long"), F.lit(256)) for i in range(count - 1, -1, -1)]


def inet(number: Column) -> Column:
    return F.concat_ws(".", F.lit("10"), *octets(number, 3))


def cidr(number: Column) -> Column:
    return F.concat(F.concat_ws(".", F.lit("10"), *octets(number, 2)), F.lit(".0/24"))


def macaddr(number: Column) -> Column:
    return F.concat_ws(":", F.lit("08"), F.lit("00"), F.lit("2b"), *[F.lpad(F.lower(F.hex(o)), 2, "0") for o in octets(number, 3)])


def hex_tag(number: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(number)), width, "0")


def bytes_hex(number: Column, count: int) -> Column:
    """``count`` bytes, the lowest first, in hexadecimal."""
    return F.concat(*[F.lpad(F.lower(F.hex(o)), 2, "0") for o in reversed(octets(number, count))])


def octet_text(number: Column, count: int) -> Column:
    """``count`` bytes: the seven lowest bytes of the number, lowest first, then digests of it; distinct as far as the bytes go."""
    first = bytes_hex(number, min(count, 7))
    rest = [F.sha2(F.concat(number.cast("string"), F.lit(f"/{i}")), 512) for i in range(-(-max(0, count - 7) // 64))]
    return F.unhex(F.substring(F.concat(first, *rest), 1, 2 * count))


def chosen(number: Column, values: list[str]) -> Column:
    """One of the values, in turn with the number; null where there is none."""
    if not values:
        return F.lit(None).cast("string")
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))
