"""Check texts as a catalog spells them, put into Spark's own SQL.

A catalog prints a check as ``((c)::text = ANY (ARRAY['a'::text]))`` or
``(num_nonnulls(a, b) = 1)``. What differs from Spark's SQL is spelling - casts,
arrays, pattern operators, a few functions - and is replaced word by word within
brackets. Precedence, types and three-valued logic are left to Spark, which
reads the result as any other expression. A word that is not known raises
:class:`Unread`; nothing is guessed at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class Unread(ValueError):
    """A check text that has no equal in Spark's SQL, or none that is known."""


_WORD = re.compile(r"""\s*(?:(?P<text>[eE]?'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*")|(?P<number>[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign>::|->>|->|#>>|#>|@>|<@|&&|<>|!=|<=|>=|\|\||!~~\*|!~~|~~\*|~~|!~\*|!~|~\*|~|[-+*/%=<>()\[\],.]))""")
#: Catalog names of types, longest first where one begins another.
TYPES = {
    "character varying": "string", "character": "string", "varchar": "string", "bpchar": "string", "char": "string", "text": "string", "name": "string", "uuid": "string", "json": "string", "jsonb": "string", "inet": "string", "cidr": "string", "macaddr": "string",
    "timestamp without time zone": "timestamp_ntz", "timestamp with time zone": "timestamp", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "date": "date", "double precision": "double", "real": "float", "numeric": "decimal(38,10)", "decimal": "decimal(38,10)",
    "smallint": "smallint", "integer": "int", "int": "int", "bigint": "bigint", "boolean": "boolean", "bytea": "binary",
}
_TYPE_WORDS = {w for t in TYPES for w in t.split()}
_KEYWORDS = {"and", "or", "not", "is", "null", "true", "false", "in", "like", "ilike", "between", "distinct", "from", "case", "when", "then", "else", "end", "current_date", "current_timestamp", "rlike", "escape"}
_FUNCTIONS = {
    "lower": "lower", "upper": "upper", "length": "char_length", "char_length": "char_length", "character_length": "char_length", "octet_length": "octet_length", "btrim": "btrim", "ltrim": "ltrim", "rtrim": "rtrim", "abs": "abs", "mod": "mod", "coalesce": "coalesce", "nullif": "nullif",
    "greatest": "greatest", "least": "least", "left": "left", "right": "right", "strpos": "instr", "starts_with": "startswith", "round": "round", "floor": "floor", "ceil": "ceil", "md5": "md5", "concat": "concat", "substr": "substr", "substring": "substr",
}
_PATTERNS = {"~": "RLIKE", "!~": "NOT RLIKE", "~*": "RLIKE", "!~*": "NOT RLIKE", "~~": "LIKE", "!~~": "NOT LIKE", "~~*": "ILIKE", "!~~*": "NOT ILIKE"}
_CLASSES = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}"}
#: Kinds of a JSON text by its first character.
_JSON_KIND = "CASE substr(ltrim({0}), 1, 1) WHEN '{{' THEN 'object' WHEN '[' THEN 'array' WHEN '\"' THEN 'string' WHEN 't' THEN 'boolean' WHEN 'f' THEN 'boolean' WHEN 'n' THEN 'null' WHEN '' THEN NULL ELSE 'number' END"

Words = list  # of (kind, text), or of a list of Words: the inside of brackets


def _words(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        if not (m := _WORD.match(text, at)):
            raise Unread(f"{text[at : at + 20]!r} is not known")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def _nested(words: list[tuple[str, str]]) -> Words:
    """The words with the insides of round and square brackets as lists of their own."""
    stack: list[Words] = [[]]
    for kind, text in words:
        if kind == "sign" and text in "([":
            stack.append([("open", text)])
        elif kind == "sign" and text in ")]":
            if len(stack) == 1 or stack[-1][0][1] != {")": "(", "]": "["}[text]:
                raise Unread("brackets do not match")
            stack[-2].append(stack.pop())
        else:
            stack[-1].append((kind, text))
    if len(stack) > 1:
        raise Unread("brackets do not match")
    return stack[0]


def _group(word: object, bracket: str = "(") -> bool:
    return isinstance(word, list) and word[0][1] == bracket


def _literal(text: str) -> str:
    if text[0] in "eE" and "\\" in text:
        raise Unread("escapes in a text")
    inner = text[text.index("'") + 1 : -1].replace("''", "'")
    return "'" + inner.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _regex(text: str, fold: bool) -> str:
    inner = text[text.index("'") + 1 : -1]
    for name, java in _CLASSES.items():
        inner = inner.replace(f"[:{name}:]", java)
    if "[:" in inner or re.search(r"\\[mMyYA]|\(\?|\*\*\*", inner):
        raise Unread("a pattern with signs of its own")
    return _literal("'" + ("(?i)" if fold else "") + inner + "'")


def _commas(words: Words) -> list[Words]:
    parts: list[Words] = [[]]
    for w in words:
        if w == ("sign", ","):
            parts.append([])
        else:
            parts[-1].append(w)
    return parts


def _items(word: Words) -> list[Words]:
    """The items of ``(ARRAY[...])``, ``ARRAY[...]::type[]`` and the like."""
    inner = word[1:]
    while inner and _group(inner[0]) and not (len(inner) > 1 and not isinstance(inner[1], tuple)):
        inner = inner[0][1:]
    if len(inner) < 2 or inner[0][:1] != ("name",) or inner[0][1].upper() != "ARRAY" or not _group(inner[1], "["):
        raise Unread("ANY of something other than an array")
    return _commas(inner[1][1:])


def _type(words: Words, i: int) -> tuple[str, int]:
    """The type that begins at word i, and the word after it."""
    names = []
    while i < len(words) and isinstance(words[i], tuple) and words[i][0] == "name" and words[i][1].lower() in _TYPE_WORDS and " ".join([*names, words[i][1].lower()]) in {" ".join(t.split()[: len(names) + 1]) for t in TYPES}:
        names.append(words[i][1].lower())
        i += 1
        if names[-1] in ("timestamp", "varying", "char", "varchar", "numeric", "decimal", "bpchar", "character") and i < len(words) and _group(words[i]) and all(w[0] in ("number", "open") or w == ("sign", ",") for w in words[i]):
            size = [w[1] for w in words[i] if w[0] == "number"]
            i += 1
            if names[-1] in ("numeric", "decimal"):
                return f"decimal({','.join(size)})", i
    kind = TYPES.get(" ".join(names))
    if kind is None:
        raise Unread(f"type {words[i][1] if i < len(words) and isinstance(words[i], tuple) else ' '.join(names)!r}")
    while i < len(words) and _group(words[i], "[") and len(words[i]) == 1:
        kind, i = f"array<{kind}>", i + 1
    return kind, i


def _spelled(words: Words, columns: set[str]) -> str:
    out: list[str] = []
    i = 0
    while i < len(words):
        word = words[i]
        after = words[i + 1] if i + 1 < len(words) else None
        if isinstance(word, list):
            if word[0][1] == "[":
                raise Unread("a subscript")
            out.append(f"({_spelled(word[1:], columns)})")
            i += 1
            continue
        kind, text = word
        low = text.lower()
        if kind == "text":
            out.append(_literal(text))
        elif kind == "number":
            out.append(text)
        elif kind == "quoted":
            name = text[1:-1].replace('""', '"')
            columns.add(name)
            out.append("`" + name.replace("`", "``") + "`")
        elif text == "::":
            to, i = _type(words, i + 1)
            out.append(f":: {to}")
            continue
        elif text in _PATTERNS:
            if not isinstance(after, tuple) or after[0] != "text":
                raise Unread("a pattern that is no text")
            out.append(f"{_PATTERNS[text]} {_regex(after[1], '*' in text) if '~~' not in text else _literal(after[1])}")
            i += 2
            if i < len(words) and words[i] == ("sign", "::"):
                _, i = _type(words, i + 1)
            continue
        elif text in ("=", "<>", "!=") and isinstance(after, tuple) and after[1].upper() in ("ANY", "ALL") and i + 2 < len(words) and _group(words[i + 2]):
            if (text == "=") != (after[1].upper() == "ANY"):
                raise Unread("ANY and ALL of other comparisons")
            out.append(f"{'IN' if text == '=' else 'NOT IN'} ({', '.join(_spelled(p, columns) for p in _items(words[i + 2]))})")
            i += 3
            continue
        elif kind == "sign":
            if text in (".", "->>", "->", "#>>", "#>", "@>", "<@", "&&"):
                raise Unread(f"sign {text}")
            out.append(text)
        elif low in ("num_nonnulls", "num_nulls") and _group(after):
            wanted = "IS NOT NULL" if low == "num_nonnulls" else "IS NULL"
            out.append("(" + " + ".join(f"CAST(({_spelled(p, columns)}) {wanted} AS INT)" for p in _commas(after[1:])) + ")")
            i += 1
        elif low in ("jsonb_typeof", "json_typeof") and _group(after):
            out.append("(" + _JSON_KIND.format(_spelled(after[1:], columns)) + ")")
            i += 1
        elif low == "cardinality" and _group(after):
            inner = _spelled(after[1:], columns)
            out.append(f"(CASE WHEN ({inner}) IS NOT NULL THEN size({inner}) END)")
            i += 1
        elif low == "array" and _group(after, "["):
            out.append(f"array({', '.join(_spelled(p, columns) for p in _commas(after[1:]))})")
            i += 1
        elif low in _KEYWORDS:
            out.append(low.upper())
        elif low in _TYPE_WORDS and isinstance(after, tuple) and after[0] == "text":  # date '2020-01-01'
            out.append(f"CAST({_literal(after[1])} AS {TYPES[low]})")
            i += 1
        elif _group(after):
            if low not in _FUNCTIONS:
                raise Unread(f"function {text}")
            out.append(f"{_FUNCTIONS[low]}({', '.join(_spelled(p, columns) for p in _commas(after[1:])) if len(after) > 1 else ''})")
            i += 1
        else:
            columns.add(low)
            out.append(f"`{low}`")
        i += 1
    return " ".join(out)


def predicate(text: str) -> tuple[str, frozenset[str]]:
    """A check, with or without CHECK and NOT VALID, in Spark's SQL, and the columns that it names."""
    body = re.sub(r"(?i)^\s*CHECK\s*(?=\()|\s+NOT VALID\s*$", "", text)
    columns: set[str] = set()
    made = _spelled(_nested(_words(body)), columns)
    if not made:
        raise Unread("no text")
    return made, frozenset(columns)


def evaluated(text: str) -> Column:
    """The check as an expression: true, false, or null where it does not decide."""
    return F.expr(predicate(text)[0])
