"""String functions over names, paths, code lines and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_name(name: Column) -> Column:
    return F.substring_index(name, "::", -1)


def qualified_name(name: Column, scope: Column) -> Column:
    scope = F.trim(F.coalesce(scope, F.lit("")))
    return F.when((scope != "") & ~name.contains("::"), F.concat(scope, F.lit("::"), name)).otherwise(name)


def return_type(typeref: Column) -> Column:
    """What follows the first colon, or all of it."""
    typeref = F.coalesce(typeref, F.lit(""))
    at = F.locate(":", typeref)
    return F.when(at > 0, F.substring(typeref, at + 1, F.length(typeref))).otherwise(typeref)


def normal_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def escape_like(text: Column) -> Column:
    for c in "\\%_":
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.^$|?*+(){}\[\]#&~\-])", r"\\$1")


def slice_lines(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last, from 1, within what there is."""
    lines = F.split(text, "\r?\n")
    first = F.greatest(F.lit(1), first)
    n = F.greatest(F.lit(0), F.least(last, F.size(lines)) - first + 1)
    return F.array_join(F.slice(lines, first, n), "\n")


def statement_end(text: Column, first: Column) -> Column:
    """The first line from ``first`` on that holds a semicolon, else ``first``."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.when(line.contains(";") & (i + 1 >= first), i + 1))
    return F.coalesce(F.array_min(lines), first)


def access_type(name: Column, line: Column) -> Column:
    """``write`` if the line assigns, updates or compares by ``==`` after the name, else ``read``."""
    n = escape_regex(name)
    after = F.concat(F.lit(r"\b"), n, F.lit(r"\s*(\[.*?\]\s*)?([-+*/%&|^]?=|\+\+|--)"))
    before = F.concat(F.lit(r"(\+\+|--)\s*\b"), n, F.lit(r"\b"))
    return F.when(F.regexp_like(line, after) | F.regexp_like(line, before), "write").otherwise("read")


#: What counts as a null check of {v}.
NULL_CHECKS = (
    r"if\s*\(\s*!\s*{v}\b",
    r"if\s*\(\s*{v}\s*==\s*(?:NULL|nullptr|0)\s*[)&|]",
    r"if\s*\(\s*(?:NULL|nullptr|0)\s*==\s*{v}\b",
    r"if\s*\(\s*{v}\s*!=\s*(?:NULL|nullptr|0)\s*[)&|]",
    r"assert\s*\(\s*{v}\b",
    r"assert\s*\(\s*{v}\s*!=",
    r"\bif\s*\(\s*{v}\s*\)",
)
#: What counts as a null check of the chain {e}.
CHAIN_CHECKS = (
    r"if\s*\(\s*!\s*{e}\s*[)&|,]",
    r"if\s*\(\s*{e}\s*==\s*(?:NULL|nullptr|0)\s*[)&|,]",
    r"if\s*\(\s*(?:NULL|nullptr|0)\s*==\s*{e}\s*[)&|,]",
    r"if\s*\(\s*{e}\s*!=\s*(?:NULL|nullptr|0)\s*[)&|,]",
    r"assert\s*\(\s*{e}\b",
    r"assert\s*\(\s*{e}\s*!=",
    r"\bif\s*\(\s*{e}\s*\)",
    r"\bif\s*\(\s*{e}\s*&&",
    r"!\s*{e}\s*\|\|",
    r"if\s*\(\s*{e}\s*[)&|]",
)


#: An identifier or chain of identifiers and subscripts in a check.
_NAME = r"[A-Za-z_]\w*(?:(?:->|\.)\w+)*"
_CHAIN = r"[A-Za-z_]\w*(?:\s*->\s*\w+|\s*\.\s*\w+|\s*\[[^\[\]]*\])*"


def _checked(text: Column, templates, mark: str, name: str) -> Column:
    """What stands at the mark of any template, in all of the text: one constant pattern a template. Checks may overlap (a
    chain checked in a call within a check), so a pattern looks ahead and takes no text."""
    found = [F.regexp_extract_all(text, F.lit("(?=(?:" + t.replace(mark, f"({name})", 1) + "))"), F.lit(1)) for t in templates]
    hinted = text.contains("if") | text.contains("assert") | text.contains("||")
    return F.when(hinted, F.array_distinct(F.concat(*found))).otherwise(F.array().cast("array<string>"))


def checked_names(body: Column) -> Column:
    """All names that the body checks for null. A template without an end at the name also holds for what the name begins
    with, up to a place where a word ends."""
    found = _checked(body, NULL_CHECKS, "{v}", _NAME)
    open_ended = _checked(body, [t for t in NULL_CHECKS if t.endswith(r"{v}\b")], "{v}", _NAME)
    # A name as far as each of its members.
    heads = F.flatten(F.transform(open_ended, _prefixes))
    return F.array_distinct(F.concat(found, heads))


def _prefixes(chain: Column) -> Column:
    """a->b.c as a, a->b, a->b.c."""
    steps = F.regexp_extract_all(chain, F.lit(r"((?:->|\.)?\w+)"), F.lit(1))
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), ""))


def null_guarded(body: Column, name: Column) -> Column:
    return F.array_contains(checked_names(body), name)


def checked_chains(body: Column) -> Column:
    """All chains that the body checks for null, without blanks around ``->`` and brackets."""
    found = _checked(body, CHAIN_CHECKS, "{e}", _CHAIN)
    open_ended = _checked(body, [t for t in CHAIN_CHECKS if t.endswith(r"{e}\b")], "{e}", _CHAIN)
    steps = lambda c: F.regexp_extract_all(c, F.lit(r"((?:->|\.)?\w+|\[[^\[\]]*\])"), F.lit(1))
    prefixes = F.flatten(F.transform(F.transform(open_ended, normal_expression), lambda c: F.transform(F.sequence(F.lit(1), F.size(steps(c))), lambda i: F.array_join(F.slice(steps(c), F.lit(1), i), ""))))
    return F.array_distinct(F.concat(F.transform(found, normal_expression), prefixes))


def chain_guarded(body: Column, expression: Column) -> Column:
    """Null checks of a chain; blanks are allowed around ``->`` and brackets."""
    return F.array_contains(checked_chains(body), normal_expression(expression))


def normal_expression(text: Column) -> Column:
    text = F.trim(text)
    for pattern, to in ((r"\s*->\s*", "->"), (r"\s*\[\s*", "["), (r"\s*\]\s*", "]"), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, to)
    return text


def first_matching_line(text: Column, pattern: Column, start_line: Column) -> Column:
    """Absolute number of the first line that matches, else ``start_line``."""
    hits = F.transform(F.split(text, "\r?\n"), lambda line, i: F.when(F.regexp_like(line, pattern), start_line + i))
    return F.coalesce(F.array_min(hits), start_line)


def line_of_match(text: Column, pattern: Column, start_line: Column) -> Column:
    """As first_matching_line, by one search of the whole text, for patterns that do not match across lines."""
    at = F.regexp_instr(text, pattern)
    before = F.substring(text, F.lit(1), at)
    newlines = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return F.when(at > 0, start_line + newlines).otherwise(start_line)


def keyword_at_boundary(name: Column, keyword: str) -> Column:
    """The keyword, in either case, after the start, a ``_`` or a small letter, before the end, a ``_`` or a capital."""
    return F.regexp_like(name, F.lit(r"(?:^|_|(?<=[a-z]))(?i:" + keyword + r")(?=$|_|[A-Z])"))


def terms_in(text: Column, terms: list[str]) -> Column:
    """Sorted distinct terms that occur in the lower-cased text without separators; the longest wins at a place."""
    pattern = "|".join(sorted(terms, key=lambda t: (-len(t), t)))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", ""), F.lit(f"({pattern})"), F.lit(1))))


def call_names(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))


#: Names and calls that allocate and that free memory.
ALLOC_NAME = r"(?i)(malloc|calloc|realloc|reallocarray|alloc|zalloc|strdup|strndup|memdup|new)"
FREE_NAME = r"(?i)(free|release|dealloc|delete|destroy|cleanup|clean_up|dispose|unref)"
ALLOC_CALL = r"\b(malloc|calloc|realloc|reallocarray|strdup|strndup|memdup|kmalloc|kzalloc|vmalloc|vzalloc|g_malloc|g_new|OPENSSL_malloc)\s*\("
FREE_CALL = r"\b(free|kfree|vfree|g_free|OPENSSL_free)\s*\(|\bdelete(?:\s*\[\s*\])?\b"


def role_hint(name: Column, body: Column) -> Column:
    body = F.coalesce(body, F.lit(""))
    alloc, free = name.rlike(ALLOC_NAME) | body.rlike(ALLOC_CALL), name.rlike(FREE_NAME) | body.rlike(FREE_CALL)
    return F.when(alloc & ~free, "alloc").when(free & ~alloc, "free").otherwise("unknown")


#: Fixed values, in order: what a pair's names drop.
PAIR_TOKENS = {"alloc": ("malloc", "calloc", "realloc", "alloc", "zalloc", "create", "new"), "free": ("free", "release", "dealloc", "destroy", "delete")}


def pair_name(name: Column, role: str) -> Column:
    value = F.lower(short_name(name))
    for token in PAIR_TOKENS[role]:
        value = F.replace(F.regexp_replace(value, f"(^|_){token}($|_)", "_"), F.lit(token), F.lit(""))
    return F.regexp_replace(value, "[^a-z0-9]+", "")


def stable_id(*parts: Column, length: int = 20) -> Column:
    """Leading hex digits of the SHA-1 of the parts, joined by a zero character."""
    return F.substring(F.sha1(F.concat_ws("\0", *parts).cast("binary")), 1, length)


def safe_filename(name: Column, fallback: str = "unnamed") -> Column:
    safe = F.trim(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit(fallback))


def merge_text(a: Column, b: Column, joiner: str = "\n") -> Column:
    """Both, unless one holds the other."""
    a, b = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    return F.when((b == "") | a.contains(b), a).when((a == "") | b.contains(a), b).otherwise(F.concat(a, F.lit(joiner), b))


def folded(name: Column) -> Column:
    """Without white space, in small letters, for comparing names."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", ""))


def preview(text: Column, limit: int = 200) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    more = F.concat(F.substring(flat, 1, limit), F.lit("... ("), (F.length(flat) - limit).cast("string"), F.lit(" more)"))
    return F.when(F.length(flat) > limit, more).otherwise(flat)


def fence(text: Column) -> Column:
    """A run of backquotes longer than any in the text, three at least."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


def truncated(text: Column, limit: int, marker: str) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def bounded_int(value: Column, low: int, high: int, default: int) -> Column:
    parsed = F.expr("null") if value is None else value.try_cast("int")
    return F.when(parsed.isNull(), default).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), parsed)))


def minutes_of_day(text: Column) -> Column:
    """Minutes of ``HH:MM``; null if it is no such time."""
    parts = F.split(F.trim(text), ":")
    hour, minute = parts.getItem(0).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    return F.when((F.size(parts) == 2) & hour.between(0, 23) & minute.between(0, 59), hour * 60 + minute)


def in_time_window(at: Column, start: Column, end: Column, weekdays: Column) -> Column:
    """Whether the time lies in the window (minutes of day; past midnight if start is after end) on one of the weekdays
    (1 is Monday); the day is that of the time itself."""
    now = F.hour(at) * 60 + F.minute(at)
    inside = F.when(start < end, (now >= start) & (now < end)).otherwise((now >= start) | (now < end))
    return inside & F.array_contains(weekdays, (F.weekday(at) + 1).cast("int")) & (start != end)


def macro_names(text: Column) -> Column:
    """Names of the macros that the text defines; lines that end in a backslash go on in the next one."""
    return F.regexp_extract_all(F.regexp_replace(text, r"\\\r?\n", " "), F.lit(r"(?m)^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)"), F.lit(1))
