"""Symbols of languages with braces: function definitions of C and C++, method definitions of JavaScript and TypeScript.

No grammar library is needed: comments, literals and preprocessor lines are masked at equal length, brackets are paired, and
heads of definitions are told by what stands before and after their parentheses.  Functions that aren't methods in JavaScript
and TypeScript, and other languages, are no symbols.  A text whose brackets don't pair has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

from quarry.functions.text import symbol_of

_COMMENT = r"//[^\n]*|/\*.*?\*/"
_QUOTED = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
_MASKS = {
    "c": re.compile(rf'(?P<blank>{_COMMENT}|^[ \t]*#(?:\\\n|[^\n])*)|R"(?P<d>[^()\\\s]{{0,16}})\(.*?\)(?P=d)"|{_QUOTED}', re.S | re.M),
    "js": re.compile(rf"(?P<blank>{_COMMENT})|{_QUOTED}|`(?:\\.|[^`\\])*`|(?P<before>(?:[=(,:!&|?\[{{}};]|\breturn)\s*)/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/", re.S),
}
_CLOSES = {")": "(", "]": "[", "}": "{"}


def masked(source: str, kind: str) -> str:
    """source with blanks for comments and preprocessor lines and S for each character of a literal; line feeds stay."""

    def cover(m: re.Match) -> str:
        groups = m.groupdict()
        keep = groups.get("before") or ""
        return keep + re.sub(r"[^\n]", " " if groups["blank"] is not None else "S", m[0][len(keep) :])

    return _MASKS[kind].sub(cover, source)


_BRANCH = re.compile(r"[ \t]*#[ \t]*(if|else|elif|endif)")


def one_branch(source: str) -> str:
    """source with spaces for what stands between an #else or #elif and its #endif: of branches that a preprocessor picks from, the first."""
    out, other = [], []  # other: of the open #ifs, whether this is a later branch
    for line in source.split("\n"):
        m = _BRANCH.match(line)
        if m and m[1] == "if":
            other.append(any(other[-1:]))
        elif m and other and m[1] in ("else", "elif"):
            other[-1] = True
        elif m and other and m[1] == "endif":
            other.pop()
        out.append(" " * len(line) if any(other[-1:]) else line)
    return "\n".join(out)


def pairs(code: str) -> dict[int, int] | None:
    """The place of each opening bracket's closing one; None where they don't pair."""
    found, open_ = {}, []
    for m in re.finditer(r"[()\[\]{}]", code):
        if m[0] not in _CLOSES:
            open_.append(m.start())
        elif open_ and code[open_[-1]] == _CLOSES[m[0]]:
            found[open_.pop()] = m.start()
        else:
            return None
    return None if open_ else found


# --- C and C++ -----------------------------------------------------------------------------------------------------

_AGGREGATE = re.compile(r"\s*(?:typedef\s+)?(?:struct|class|union|enum)\b")
_QUALIFIERS = re.compile(r"\s*(?:(?:const|volatile|noexcept|override|final|mutable|throw|try|&&?)\s*)*(?:->.*)?", re.S)
_DECLARED = re.compile(r"\s*[A-Za-z_]\w*+(?:[\s*]+[A-Za-z_]\w*+)+(?:\s*\[\w*\])*(?:\s*,[\s*]*[A-Za-z_]\w*+(?:\s*\[\w*\])*)*\s*")
_ACCESS = re.compile(r"\s*(?:public|private|protected)\s*")


def _after_template(code: str, at: int, end: int) -> int:
    """Where the head proper starts, past white space and template parameters."""
    while True:
        at = re.compile(r"\s*").match(code, at, end).end()
        m = re.compile(r"template\s*<").match(code, at, end)
        if not m:
            return at
        depth, at = 1, m.end()
        while depth and at < end:
            depth += {"<": 1, ">": -1}.get(code[at], 0)
            at += 1


def _is_function(code: str, start: int, brace: int, groups: list[tuple[int, int]]) -> bool:
    if not groups or re.match(r"(?:inline\s+)?namespace\b", code[start:brace]):
        return False
    before, tail = code[start : groups[0][0]], code[groups[-1][1] + 1 : brace]
    if re.search(r"(?<!operator)(?<![=<>!+\-*/%&|^])=(?!=)", re.sub(r"operator\s*\S+", "operator", before)):
        return False  # an initializer
    return not (_AGGREGATE.match(before) and not _QUALIFIERS.fullmatch(tail) and ":" not in tail) and not re.fullmatch(r"\s*[\w\s]+=\s*", tail)


def _c_spans(code: str, close: dict[int, int]) -> Iterator[tuple[int, int]]:
    stop = re.compile(r"[;{(\[:]")
    todo = [(0, len(code))]
    while todo:
        at, end = todo.pop()
        start, groups, old = at, [], 0  # old: behind the last declaration between a head's parameters and its body
        while m := stop.search(code, at, end):
            i, at = m.start(), m.end()
            if m[0] in "([":
                at = close[i] + 1
                if m[0] == "(":
                    if old:
                        start, groups, old = old, [], 0
                    groups.append((i, close[i]))
            elif m[0] == ":":
                if _ACCESS.fullmatch(code, start, i):
                    start = at
            elif m[0] == ";":
                if groups and _DECLARED.fullmatch(code, old or groups[-1][1] + 1, i) and not re.search(r"=|\btypedef\b", code[start : groups[0][0]]):
                    old = at
                else:
                    start, groups, old = at, [], 0
            else:
                if old and not code[old:i].isspace() and i > old:
                    start, groups = old, []
                old, head = 0, _after_template(code, start, i)
                own = [g for g in groups if g[0] >= head]
                at = close[i] + 1
                if _is_function(code, head, i, own):
                    tail = code[own[0][1] + 1 : i].replace("::", "  ")
                    if ":" in tail and re.search(r"[\w>]\s*$", tail):
                        continue  # a member set by braces in a constructor's list
                    yield head, close[i] + 1
                elif not re.search(r"\benum\b|=\s*$", code[head:i]) and (_AGGREGATE.match(code, head, i) or re.match(r"(?:inline\s+)?namespace\b|extern\s+S+\s*$", code[head:i])):
                    todo.append((i + 1, close[i]))
                start, groups = at, []


# --- JavaScript and TypeScript -------------------------------------------------------------------------------------

_METHOD = re.compile(r"(?<![\w$#.])(?P<name>[\w$#]++|\[[^\[\]{}]*+\])\s*+\??\s*+(?:<[^(){}]{0,500}>\s*+)?\(")
_MODIFIER = re.compile(r"(?<![\w$#.])(?:public|private|protected|static|async|override|get|set)$")
_NO_METHOD = {"if", "for", "while", "switch", "catch", "function", "with", "super", "return", "await"}


def _with_modifiers(code: str, at: int) -> int:
    """Where the modifiers before a method's name start."""
    while True:
        end = at
        while end and code[end - 1].isspace():
            end -= 1
        if end and code[end - 1] == "*":
            at = end - 1
        elif end < at and (m := _MODIFIER.search(code, max(0, end - 10), end)):
            at = m.start()
        else:
            return at


def _body(code: str, at: int, close: dict[int, int], typed: bool) -> int | None:
    """The brace that opens a method's body, after its parameters and, where typed, the type of its result."""
    space = re.compile(r"\s*")
    at = space.match(code, at).end()
    if typed and code[at : at + 1] == ":":
        last, at = ":", at + 1
        while at < len(code):
            c = code[at]
            if c in "([" or (c == "{" and (last in ":|&,<?" or last == "=>")):
                last, at = "x", close[at] + 1
            elif c in "{;)]}" or (c == "=" and code[at + 1 : at + 2] != ">"):
                break
            elif c == "=":
                last, at = "=>", at + 2
            else:
                last, at = c if not c.isspace() else last, at + 1
    return at if code[at : at + 1] == "{" else None


def _js_spans(code: str, close: dict[int, int], typed: bool) -> Iterator[tuple[int, int]]:
    depths, depth = [], 0
    for m in re.finditer(r"[{}]", code):
        depth += 1 if m[0] == "{" else -1
        depths.append((m.start(), depth))
    k, at = 0, 0
    while m := _METHOD.search(code, at):
        at, start = m.end(), _with_modifiers(code, m.start())
        while k < len(depths) and depths[k][0] < start:
            k += 1
        if not k or not depths[k - 1][1] or m["name"] in _NO_METHOD:
            continue
        before = re.search(r"[\w$]*\s*\*?\s*$", code[max(0, start - 40) : start])[0].strip(" \t\r\n*")
        if before in {"function", "extends", "case", "new"}:
            continue
        brace = _body(code, close[m.end() - 1] + 1, close, typed)
        if brace is not None:
            yield start, close[brace] + 1


# --- both ----------------------------------------------------------------------------------------------------------


def brace_symbols(source: str, language: str) -> list[tuple]:
    """(text, type, name, line_start, line_end, start, end) in preorder, as chunking.python_symbols has them; offsets in bytes.

    All are of type function and named by symbol_of.  A C++ function that is local to a function's class, and a definition by
    `= default` or `= delete`, are none."""
    kind = {"c": "c", "cpp": "c", "javascript": "js", "typescript": "js"}.get(language)
    if not kind:
        return []
    code = masked(one_branch(source) if kind == "c" else source, kind)
    close = pairs(code)
    if close is None:
        return []
    spans = sorted(_c_spans(code, close) if kind == "c" else _js_spans(code, close, language == "typescript"), key=lambda s: (s[0], -s[1]))
    byte = range(len(source) + 1) if source.isascii() else [0, *accumulate(len(c.encode()) for c in source)]
    line = [0, *accumulate(c == "\n" for c in source)]
    return [(source[lo:hi], "function", symbol_of(source[lo:hi]), line[lo] + 1, line[hi - 1] + 1, byte[lo], byte[hi]) for lo, hi in spans]
