r"""Readings of constraint texts as column expressions.

Checks, index definitions, trigger bodies and partition bounds come as text. A
closed list of exact shapes is recognised; whatever is not on the list is
``unknown``, never guessed at. Readings are expressions over a column of texts,
so a catalog of any number of schemas is read by one scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_COLUMN = r'"?([A-Za-z_][A-Za-z0-9_]*)"?'
_CAST = r"(?:::[a-z ]+(?:\([0-9, ]+\))?)?"
_NAMED = rf"\(?\(?{_COLUMN}\)?{_CAST}\)?"
_NUMBER = r"\(?'?(-?[0-9]+)'?\)?" + _CAST
_LITERAL = rf"(?:'(?:[^']|'')*'{_CAST}|-?[0-9]+(?:\.[0-9]+)?|true|false)"


def _nested(depth: int) -> str:
    """Text whose brackets are balanced, so many levels deep at most."""
    return "[^()]*" if depth == 0 else rf"(?:[^()]|\({_nested(depth - 1)}\))*"


_PART = rf"\({_nested(4)}\)"


def bare(text: Column) -> Column:
    """A check without CHECK, NOT VALID and the brackets around the whole."""
    out = F.regexp_replace(F.trim(text), r"(?i)\s+NOT VALID$", "")
    out = F.regexp_replace(out, r"(?i)^CHECK\s*", "")
    for _ in range(3):  # brackets that hold no other ones at their own depth
        out = F.regexp_replace(out, rf"^\(({_nested(4)})\)$", "$1")
    return out


def _shape(pattern: str) -> str:
    return rf"(?is)^{pattern}$"


#: Shapes of checks in order of precedence: meaning, pattern, group of the column, group of the bound.
CHECKS: list[tuple[str, str, int, int]] = [
    ("value_set", rf"{_NAMED} = ANY \(+ARRAY\[{_LITERAL}(?:, ?{_LITERAL})*\]\)?(?:::[a-z \[\]]+)?\)+", 1, 0),
    ("value_set", rf"{_NAMED} IN \({_LITERAL}(?:, ?{_LITERAL})*\)", 1, 0),
    ("value_set", rf"{_NAMED} = {_LITERAL}", 1, 0),
    ("exactly_one", rf"num_nonnulls\((?:{_COLUMN}, ?)+{_COLUMN}\) = 1", 0, 0),
    ("exactly_one", rf"\({_COLUMN} IS NULL\) <> \({_COLUMN} IS NULL\)", 1, 0),
    ("not_null", rf"{_NAMED} IS NOT NULL", 1, 0),
    ("lowercase", rf"{_NAMED} = lower\({_NAMED}\){_CAST}", 1, 0),
    ("byte_length", rf"octet_length\({_NAMED}\) = {_NUMBER}", 1, 2),
    ("byte_limit", rf"octet_length\({_NAMED}\) <= {_NUMBER}", 1, 2),
    ("length_limit", rf"(?:char_length|character_length|length)\({_NAMED}\) <= {_NUMBER}", 1, 2),
    ("length_limit_below", rf"(?:char_length|character_length|length)\({_NAMED}\) < {_NUMBER}", 1, 2),
    ("min_length", rf"(?:char_length|character_length|length)\({_NAMED}\) >= {_NUMBER}", 1, 2),
    ("min_length_above", rf"(?:char_length|character_length|length)\({_NAMED}\) > {_NUMBER}", 1, 2),
    ("cardinality_limit", rf"cardinality\({_NAMED}\) <= {_NUMBER}", 1, 2),
    ("lower_bound", rf"{_NAMED} >= {_NUMBER}", 1, 2),
    ("lower_bound_above", rf"{_NAMED} > {_NUMBER}", 1, 2),
    ("upper_bound", rf"{_NAMED} <= {_NUMBER}", 1, 2),
    ("upper_bound_below", rf"{_NAMED} < {_NUMBER}", 1, 2),
    ("lower_bound_flipped", rf"{_NUMBER} <= {_NAMED}", 2, 1),
    ("upper_bound_flipped", rf"{_NUMBER} >= {_NAMED}", 2, 1),
    ("non_empty", rf"{_NAMED} <> ''{_CAST}", 1, 0),
    ("json_type", rf"jsonb?_typeof\({_NAMED}\) = '(object|array|string|number|boolean|null)'{_CAST}", 1, 0),
    ("all_non_null", rf"num_nonnulls\({_COLUMN}, ?{_COLUMN}\) = 2", 0, 0),
    ("at_least_one", rf"num_nonnulls\((?:{_COLUMN}, ?)+{_COLUMN}\) (?:>= 1|> 0)", 0, 0),
    ("at_least_one", rf"\({_COLUMN} IS NOT NULL\)(?: OR \({_COLUMN} IS NOT NULL\))+", 0, 0),
    ("must_be_null", rf"\({_COLUMN} IS NULL\) OR .+", 1, 0),
    ("not_null", rf"\({_COLUMN} IS NOT NULL\) OR .+", 1, 0),
]
_SHIFT = {"length_limit_below": ("length_limit", -1), "min_length_above": ("min_length", 1), "lower_bound_above": ("lower_bound", 1), "upper_bound_below": ("upper_bound", -1), "lower_bound_flipped": ("lower_bound", 0), "upper_bound_flipped": ("upper_bound", 0)}


def check(text: Column) -> Column:
    """struct<meaning, column_name, bound> of one conjunct of a check."""
    body = bare(text)
    none = F.lit(None)
    out = F.struct(F.lit("unknown").alias("meaning"), none.cast("string").alias("column_name"), none.cast("long").alias("bound"))
    for meaning, pattern, column, bound in reversed(CHECKS):
        name, shift = _SHIFT.get(meaning, (meaning, 0))
        where = _shape(pattern)
        same = F.lower(F.regexp_extract(body, where, 1)) == F.lower(F.regexp_extract(body, where, 2)) if meaning == "lowercase" else F.lit(True)
        fits = body.rlike(where) & same
        if name == "min_length":  # a longer filling than this is not made
            fits = fits & (F.regexp_extract(body, where, bound).cast("decimal(38,0)") <= 4_096)
        if name == "cardinality_limit":
            fits = fits & (F.regexp_extract(body, where, bound).cast("decimal(38,0)") >= 1)
        found = F.struct(
            F.lit(name).alias("meaning"),
            (F.regexp_extract(body, where, column) if column else none.cast("string")).alias("column_name"),
            ((F.regexp_extract(body, where, bound).try_cast("long") + shift) if bound else none.cast("long")).alias("bound"),
        )
        out = F.when(fits, found).otherwise(out)
    return out


def conjuncts(text: Column) -> Column:
    """The parts of a top-level AND of bracketed or of plain parts; a text that is no such AND is its only part.

    Plain parts have no quotes and brackets, so an AND in them is none of a literal.
    """
    body = bare(text)
    whole = rf"(?is)^{_PART}(?: AND {_PART})+$"
    plain = body.rlike(r"(?is)^[^'()]+?( AND [^'()]+)+$") & ~body.rlike(r"(?i) (OR|BETWEEN) ")
    return F.when(body.rlike(whole), F.regexp_extract_all(body, F.lit(_PART), F.lit(0))).when(plain, F.split(body, "(?i) AND ")).otherwise(F.array(body))


def obligation(part: Column) -> Column:
    """:func:`check` of one conjunct, with ``names`` of the columns that it counts nulls of, ``literals`` of a value set and ``kind`` of a JSON type."""
    body = bare(part)
    found = check(part)
    meaning = found["meaning"]
    listed = F.split(F.regexp_extract(body, r"(?i)^num_nonnulls\(([^()]*)\)", 1), r"\s*,\s*")
    nulls = F.regexp_extract_all(body, F.lit(rf"(?i){_COLUMN}\)? IS (?:NOT )?NULL"), F.lit(1))
    names = F.when(body.rlike("(?i)^num_nonnulls"), F.transform(listed, lambda n: F.translate(n, '"', ""))).otherwise(nulls)
    right = F.regexp_replace(F.regexp_extract(body, r"(?is)(?:=| IN )(.*)$", 1), r"::[a-z ]+(?:\([0-9, ]+\))?(?:\[\])?", "")
    literals = F.regexp_extract_all(right, F.lit(r"(?i)'((?:[^']|'')*)'|(-?[0-9]+(?:\.[0-9]+)?|\btrue\b|\bfalse\b)"), F.lit(0))
    literals = F.transform(literals, lambda v: F.when(v.startswith("'"), F.replace(F.substring(v, F.lit(2), F.char_length(v) - 2), F.lit("''"), F.lit("'"))).otherwise(v))
    return F.struct(
        *[found[n].alias(n) for n in ("meaning", "column_name", "bound")],
        F.when(meaning.isin("exactly_one", "at_least_one", "all_non_null"), names).alias("names"),
        F.when(meaning == "value_set", literals).alias("literals"),
        F.when(meaning == "json_type", F.regexp_extract(body, r"= '(\w+)'", 1)).alias("kind"),
    )


def index(text: Column) -> Column:
    """struct<reading, columns> of an index definition: columns, lowered, harmless or unknown.

    A unique partial index is read as a full one, which is the stricter rule.
    Included columns and ordering do not matter to uniqueness.
    """
    keys = F.regexp_extract(text, rf"(?is)\bUSING\s+\w+\s*\(({_nested(4)})\)", 1)
    unique = text.rlike(r"(?i)^CREATE UNIQUE INDEX")
    parts = F.transform(F.regexp_extract_all(keys, F.lit(rf"((?:[^(),]|\({_nested(3)}\))+)"), F.lit(1)), lambda p: F.regexp_replace(F.trim(p), r"(?i)\s+(ASC|DESC|NULLS (FIRST|LAST)|\w+_ops)\b", ""))
    plain = rf"^\(?{_COLUMN}\)?(?:::(?:text|varchar|character varying|citext))?$"
    lowered = rf"(?i)^lower\(\(*{_COLUMN}\)*(?:::(?:text|varchar|character varying))?\)*$"
    total = r"(?i)^(?:lower|upper|length|coalesce|md5|btrim|abs|char_length)\([^()]*\)$"
    reading = (
        F.when(F.forall(parts, lambda p: p.rlike(plain)) & (F.size(parts) > 0) & (keys != ""), F.when(unique, "columns").otherwise("harmless"))
        .when(unique & (F.size(parts) == 1) & parts[0].rlike(lowered), "lowered")
        .when(~unique & F.forall(parts, lambda p: p.rlike(plain) | p.rlike(total)), "harmless")
        .otherwise("unknown")
    )
    names = F.transform(parts, lambda p: F.regexp_extract(p, plain, 1))
    return F.struct(reading.alias("reading"), F.when(reading == "columns", F.array_join(names, ",")).when(reading == "lowered", F.regexp_extract(parts[0], lowered, 1)).alias("columns"))


def trigger(body: Column) -> Column:
    """struct<raises, assigns, targets>: may an insert fail, which new columns are set, which tables are written."""
    text = F.regexp_replace(F.regexp_replace(body, r"(?s)--[^\n]*|/\*.*?\*/", " "), r"'(?:[^']|'')*'", "''")
    raises = text.rlike(r"(?i)\bASSERT\b") | text.rlike(r"(?i)\bRAISE\b(?!\s+(NOTICE|WARNING|INFO|LOG|DEBUG)\b)")
    set_ = r'(?i)(?:\bNEW\.("?\w+"?)\s*:=)(?!\s*nextval\([^;]*\)\s*;)'
    # An equals sign assigns where a statement begins and compares elsewhere.
    equals = r'(?i)(?:^|;|\b(?:BEGIN|THEN|ELSE|LOOP)\b)\s*NEW\.("?\w+"?)\s*=(?!\s*nextval\([^;]*\)\s*;)'
    into = r'(?i)\bINTO\s+(?:STRICT\s+)?NEW\.("?\w+"?)'
    assigns = F.array_sort(F.array_distinct(F.transform(F.concat(*[F.regexp_extract_all(text, F.lit(way), F.lit(1)) for way in (set_, equals, into)]), lambda c: F.lower(F.translate(c, '"', "")))))
    targets = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r'(?i)(?:^|[;\s])(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM|MERGE\s+INTO)\s+("?\w+"?)'), F.lit(1)), lambda c: F.lower(F.translate(c, '"', "")))))
    return F.struct(raises.alias("raises"), F.array_join(assigns, ",").alias("assigns"), F.array_join(targets, ",").alias("targets"))


def partition(key: Column, bounds: Column) -> Column:
    """struct<reading, values, column_name, items> of a partitioned table: anything, one_of or unknown.

    Hash partitions take anything if one modulus has all its remainders; lists
    take the values listed, or anything with a default; ranges, expressions and
    tables without partitions are unknown.
    """
    hash_ = r"(?i)WITH \(modulus ([0-9]+), remainder ([0-9]+)\)"
    moduli = F.transform(F.filter(bounds, lambda b: b.rlike(hash_)), lambda b: F.regexp_extract(b, hash_, 1).cast("int"))
    rests = F.transform(F.filter(bounds, lambda b: b.rlike(hash_)), lambda b: F.regexp_extract(b, hash_, 2).cast("int"))
    covered = (F.size(moduli) == F.size(bounds)) & (F.size(bounds) > 0) & (F.array_min(moduli) == F.array_max(moduli)) & (F.size(F.array_distinct(rests)) == F.array_max(moduli))
    one = key.rlike(r"(?i)^(LIST|HASH) \(\w+(?:, ?\w+)*\)$")
    listed = F.forall(bounds, lambda b: b.rlike(r"(?i)^FOR VALUES IN \('[^']*'(?:, '[^']*')*\)$|^DEFAULT$")) & (F.size(bounds) > 0) & key.rlike(r"(?i)^LIST \(\w+\)$")
    values = F.array_sort(F.array_distinct(F.flatten(F.transform(bounds, lambda b: F.regexp_extract_all(b, F.lit("'([^']*)'"), F.lit(1))))))
    reading = F.when(key.rlike("(?i)^HASH") & one & covered, "anything").when(listed, F.when(F.array_contains(bounds, "DEFAULT"), "anything").otherwise("one_of")).otherwise("unknown")
    return F.struct(reading.alias("reading"), F.when(reading == "one_of", F.array_join(values, ",")).alias("values"), F.regexp_extract(key, r"\((\w+)\)", 1).alias("column_name"), values.alias("items"))


def glob(pattern: Column) -> Column:
    """A pattern of * and ? as a regular expression for rlike."""
    escaped = F.regexp_replace(pattern, r"([.\\+^$|(){}\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def quoted(text: Column) -> Column:
    """A string as a SQL literal."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
