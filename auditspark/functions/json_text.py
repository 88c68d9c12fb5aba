"""JSON inside free text: every balanced value, and the best one that fits a schema.

There is no built-in function for values within text; a vectorized Python function does the small parsing work a row.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "null": lambda v: v is None,
}


_BRACKET = re.compile(r"[\[{]")
_TOKEN = re.compile(
    r"""[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?Infinity|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN))"""
)
#: What may follow within a container.
_ITEM, _FIRST_ITEM, _KEY, _FIRST_KEY, _COLON, _NEXT = range(6)


def _scan(text: str, start: int, seen: bytearray, found: list[tuple[int, int, object]]) -> None:
    """Reads on from a bracket with a stack of open containers, and notes each that closes. Brackets that it passes outside
    of strings are marked: read from any of them the text is the same, so where this ends without a close, they all do."""
    stack: list[list] = []
    at, after = start, _ITEM
    while m := _TOKEN.match(text, at):
        at, mark = m.end(), m[1]
        if mark and mark in "[{":
            if after not in (_ITEM, _FIRST_ITEM):
                # It is no value here, but may begin one.
                return
            seen[at - 1] = 1
            stack.append([at - 1, [] if mark == "[" else {}, None])
            after = _FIRST_ITEM if mark == "[" else _FIRST_KEY
            continue
        if mark and mark in "]}":
            if after not in ((_FIRST_ITEM, _NEXT) if mark == "]" else (_FIRST_KEY, _NEXT)) or isinstance(stack[-1][1], list) != (mark == "]"):
                return
            begin, value, _ = stack.pop()
            found.append((begin, at, value))
            if not stack:
                return
        elif mark == ",":
            if after != _NEXT:
                return
            after = _ITEM if isinstance(stack[-1][1], list) else _KEY
            continue
        elif mark == ":":
            if after != _COLON:
                return
            after = _ITEM
            continue
        elif after in (_KEY, _FIRST_KEY):
            if not m[2]:
                return
            stack[-1][2], after = json.loads(m[2]), _COLON
            continue
        elif after in (_ITEM, _FIRST_ITEM):
            try:
                value = m[2][1:-1] if m[2] and "\\" not in m[2] else json.loads(m[2] or m[3])
            except ValueError:
                return
        else:
            return
        _, into, key = stack[-1]
        if key is None:
            into.append(value)
        else:
            into[key], stack[-1][2] = value, None
        after = _NEXT


def values_in(text: str) -> list[tuple[int, int, object]]:
    """(place, end, value) of each object or array that starts at a bracket and parses, by place.

    One pass for all brackets outside of strings, however deep; brackets within the strings of a value are read by passes of
    their own.
    """
    seen, found = bytearray(len(text)), []
    for m in _BRACKET.finditer(text):
        if not seen[m.start()]:
            _scan(text, m.start(), seen, found)
    return sorted(found, key=lambda f: f[0])


def fits(value, schema) -> bool:
    """A subset of JSON Schema: const, enum, allOf, anyOf, oneOf, type, required, properties, additionalProperties, items,
    minItems and maxItems."""
    if isinstance(schema, bool):
        return schema
    if not isinstance(schema, dict):
        return False
    rules = [
        "const" not in schema or value == schema["const"],
        not isinstance(schema.get("enum"), list) or value in schema["enum"],
        all(fits(value, s) for s in schema.get("allOf", [])),
        not schema.get("anyOf") or any(fits(value, s) for s in schema["anyOf"]),
        not schema.get("oneOf") or sum(fits(value, s) for s in schema["oneOf"]) == 1,
    ]
    if (kinds := schema.get("type")) is not None:
        rules.append(any(TYPES.get(k, lambda _: False)(value) for k in (kinds if isinstance(kinds, list) else [kinds])))
    if isinstance(value, dict):
        known = schema.get("properties", {})
        rules += [k in value for k in schema.get("required", [])]
        rules += [fits(value[k], s) for k, s in known.items() if k in value]
        rules.append(schema.get("additionalProperties") is not False or set(value) <= set(known))
    if isinstance(value, list):
        rules.append(schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)))
        rules += [fits(v, schema["items"]) for v in value] if "items" in schema else []
    return all(rules)


def fits_pattern(value, pattern, extra_keys: bool = True) -> bool:
    """A pattern of Python types, lists of one, dicts of patterns, tuples of alternatives, None for anything."""
    if pattern is None:
        return True
    if isinstance(pattern, tuple):
        return any(fits_pattern(value, p, extra_keys) for p in pattern)
    if isinstance(pattern, type):
        name = {str: "string", bool: "boolean", int: "integer", float: "number"}.get(pattern)
        return TYPES[name](value) if name else isinstance(value, pattern)
    if isinstance(pattern, dict):
        if not isinstance(value, dict) or not set(pattern) <= set(value) or (not extra_keys and set(value) != set(pattern)):
            return False
        return all(fits_pattern(value[k], p, extra_keys) for k, p in pattern.items())
    if isinstance(pattern, list):
        return isinstance(value, list) and len(pattern) == 1 and all(fits_pattern(v, pattern[0], extra_keys) for v in value)
    return value == pattern


def bracketed(text: Column) -> Column:
    """The text from its first opening to its last closing bracket: all values are in it, and no more of the text goes to Python."""
    return F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1)


def all_json(text: Column) -> Column:
    """Array of (pos, len, raw) of the JSON values in the text."""

    @F.pandas_udf("array<struct<pos:int,len:int,raw:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"pos": p, "len": e - p, "raw": t[p:e]} for p, e, _ in values_in(t or "")])

    before = F.length(F.regexp_extract(text, r"^([^\[{]*+)", 1))
    return F.transform(run(bracketed(text)), lambda v: F.struct((v["pos"] + before).alias("pos"), v["len"].alias("len"), v["raw"].alias("raw")))


def best_json(text: Column, schema: dict | None = None, pattern=None) -> Column:
    """The longest, then latest, value in the text that fits; null if there is none."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def suits(v) -> bool:
            try:
                return (schema is None or fits(v, schema)) and fits_pattern(v, pattern)
            except RecursionError:
                return False

        def best(t):
            t = t or ""
            # The longest, then latest, first: the first that fits is the answer.
            for p, e, v in sorted(values_in(t), key=lambda f: (f[0] - f[1], -f[0])):
                if suits(v):
                    return t[p:e]
            return None

        return texts.map(best)

    return run(bracketed(text))


def fits_schema(text: Column, schema: dict) -> Column:
    """Whether the text is one JSON value that fits the schema; null for a null text."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        def check(t):
            if t is None:
                return None
            try:
                return fits(json.loads(t), schema)
            except (ValueError, RecursionError):
                return False

        return texts.map(check)

    return run(text)


def string_list(text: Column) -> Column:
    """An array of strings; whatever does not parse is empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def string_map(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def signature(row: Column) -> Column:
    """For telling whether a struct has changed: its fields in order of name are the caller's part."""
    return F.sha2(F.to_json(row), 256)
