"""Tokens of C and C++ text, for the functions that Arrow batches call."""

from __future__ import annotations

import re

NOISE = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
DIRECTIVE = re.compile(r"^[ \t]*#[^\n]*(?:\\\n[^\n]*)*", re.M)
TOKEN = re.compile(r"\n|[A-Za-z_]\w*|\d[\w.]*|->|::|[-+*/%&|^!=<>]=|&&|\|\||\+\+|--|[^\s\w]")
NAME = re.compile(r"[A-Za-z_]\w*\Z")


def _blank(m: re.Match) -> str:
    text = re.sub(r"[^\n]", " ", m[0])
    return text if m[0][0] == "/" else m[0][0] + text[1:-1] + m[0][-1]


def blanked(code: str, directives: bool = True) -> str:
    """The code with comments and the insides of literals (and directives) as blanks; lines and columns stay."""
    code = NOISE.sub(_blank, code)
    return DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code) if directives else code


def tokens(code: str) -> tuple[list[str], list[int], list[int]]:
    """Tokens of blanked code with their line and column, both from 0."""
    found, lines, columns, line, begin = [], [], [], 0, 0
    for m in TOKEN.finditer(code):
        if m[0] == "\n":
            line, begin = line + 1, m.end()
        else:
            found.append(m[0])
            lines.append(line)
            columns.append(m.start() - begin)
    return found, lines, columns


def closing(tok: list[str]) -> dict[int, int]:
    """For each place of an opening bracket that of its closing one; brackets that do not match are left out."""
    pairs, out, open_ = {")": "(", "]": "[", "}": "{"}, {}, []
    for i, t in enumerate(tok):
        if t in "([{":
            open_.append(i)
        elif t in pairs:
            # An opening bracket of another kind that stands in between has no closing one.
            while open_ and tok[open_[-1]] != pairs[t] and t == "}":
                open_.pop()
            if open_ and tok[open_[-1]] == pairs[t]:
                out[open_.pop()] = i
    return out


#: Words that a bracket may follow without a call, and words that begin no declaration.
NOT_CALLED = frozenset(
    "if for while switch return sizeof alignof decltype catch else do case goto new delete throw and or not int char short long float double bool void unsigned signed auto typeof static_assert noexcept defined".split()
)
NO_TYPE = frozenset("return else do goto case sizeof new delete throw and or not in".split())


def _in_expression(tok: list[str], begin: int) -> bool:
    return begin > 0 and tok[begin - 1] not in (";", "{", "}", "(", ",", "const", "static", "struct", "unsigned", "signed", "volatile", "extern", "register", "enum", "union", ":")


def declared(tok: list[str], at: int) -> bool:
    """Whether the name at this place is declared there: a type stands before it, with stars or without."""
    before = at - 1
    while before >= 0 and tok[before] in ("*", "&"):
        before -= 1
    if before < 0 or not NAME.match(tok[before]) or tok[before] in NO_TYPE:
        return False
    # Without a star two names in a row are a declaration; with one the type has to open a statement or a parameter.
    return before == at - 1 or not _in_expression(tok, before)


def calls_of(tok: list[str], pairs: dict[int, int]) -> list[tuple[int, str]]:
    """(place, callee) of each call below the function's head: a name, a qualified name, or the last member of a chain."""
    begin = tok.index("{") if "{" in tok else len(tok)
    found = []
    for at in range(begin + 1, len(tok) - 1):
        if tok[at + 1] != "(" or at + 1 not in pairs or not NAME.match(tok[at]) or tok[at] in NOT_CALLED:
            continue
        first, name = at, tok[at]
        while first > 1 and tok[first - 1] == "::" and NAME.match(tok[first - 2]):
            first -= 2
            name = f"{tok[first]}::{name}"
        last = tok[first - 1]
        if last in ("->", "."):
            # A chain begins where its first name does.
            while first > 1 and tok[first - 1] in ("->", ".") and (NAME.match(tok[first - 2]) or tok[first - 2] in ")]"):
                first -= 2
            found.append((first, name))
        elif last != "new" and not (NAME.match(last) and last not in NO_TYPE):
            found.append((first, name))
    return found


def uses_of(tok: list[str], lines: list[int], prefix: str) -> list[tuple[int, str]]:
    """(place, name) of each name of that prefix where it is neither declared nor a declared local one."""
    local: dict[str, int] = {}
    names = [i for i, t in enumerate(tok) if t.startswith(prefix) and not (i and tok[i - 1] in ("->", ".", "::"))]
    own = {i for i in names if declared(tok, i)}
    for i in own:
        local[tok[i]] = min(lines[i], local.get(tok[i], lines[i]))
    return [(i, tok[i]) for i in names if i not in own and lines[i] < local.get(tok[i], len(tok) + lines[i] + 1)]
