"""Symbols of source code: names with first and last line."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from refloom.operators.comments import split_lines

Symbol = tuple[str, int, int]


def python_symbols(content: str) -> Iterator[Symbol]:
    """Functions and classes, without decorators; if the code doesn't parse, by indentation."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        yield from _by_indentation(content)
        return
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            yield node.name, node.lineno, node.end_lineno


_HEADER = re.compile(r"([ \t]*)(?:async[ \t]+)?(?:def|class)[ \t]+([^\W\d]\w*)")


def _by_indentation(content: str) -> Iterator[Symbol]:
    rows = split_lines(content)
    for i, row in enumerate(rows):
        if (m := _HEADER.match(row)) is None:
            continue
        last = i
        for j in range(i + 1, len(rows)):
            if not rows[j].strip():
                continue
            if len(rows[j]) - len(rows[j].lstrip()) <= len(m[1].expandtabs()):
                break
            last = j
        yield m[2], i + 1, last + 1


_OPAQUE = re.compile(
    r"//[^\n]*|(?P<open>/\*)|b?r(?P<h>#*)\".*?\"(?P=h)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\(?:u\{[0-9A-Fa-f_]*\}|x[0-9A-Fa-f]{2}|.)|[^\\'\n])'",
    re.DOTALL,
)
_ITEM = re.compile(
    r"(?P<lead>(?:\b(?:pub(?:\s*\([^)]*\))?|default|async|unsafe|const|extern(?:\s+\x00+)?)\s+)*)"
    r"\b(?:(?P<kind>fn|struct|enum|union|trait|type|const|static|mod)\s+(?:mut\s+)?(?P<name>(?:r\x23)?[A-Za-z_]\w*)|macro_rules!\s*(?P<macro>[A-Za-z_]\w*))"
)
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def _blanked(content: str) -> str:
    """The code with comments and quoted text blanked, line ends kept; quoted text becomes NULs."""
    out, at = [], 0
    while (m := _OPAQUE.search(content, at)) is not None:
        end = m.end()
        if m["open"]:
            depth = 1
            for mark in re.finditer(r"/\*|\*/", content[m.end() :]):
                depth += 1 if mark[0] == "/*" else -1
                if depth == 0:
                    end = m.end() + mark.end()
                    break
            else:
                end = len(content)
        fill = " " if m[0].startswith("/") else "\x00"
        out += [content[at : m.start()], re.sub(r"[^\n]", fill, content[m.start() : end])]
        at = end
    return "".join([*out, content[at:]])


def _end_of_item(code: str, at: int, kind: str) -> tuple[int, bool] | None:
    """Index of an item's last character, and whether it has a braced body."""
    closers: list[str] = []
    for i in range(at, len(code)):
        c = code[i]
        if c in _PAIRS:
            if c == "{" and not closers and kind not in ("type", "const", "static"):
                closers.append("}*")
            else:
                closers.append(_PAIRS[c])
        elif c in ")]}":
            if not closers:
                return None
            last = closers.pop()
            if last == "}*":
                return i, True
        elif c == ";" and not closers:
            return i, False
    return None


def rust_symbols(content: str) -> Iterator[Symbol]:
    """Functions with a body, structs, enums, unions, traits, type aliases, constants, statics, modules and macros."""
    code = _blanked(content)
    at = 0
    while (m := _ITEM.search(code, at)) is not None:
        at = m.end()
        kind, name = m["kind"] or "macro", m["name"] or m["macro"]
        if name in ("fn", "unsafe", "async", "extern") or (kind == "const" and name == "_"):
            at = m.end() - len(name)
            continue
        ended = _end_of_item(code, m.end(), kind)
        if ended is None:
            continue
        end, braced = ended
        # a function without a body is a signature; a type without a value is a bound
        if (kind == "fn" and not braced) or (kind == "type" and "=" not in code[m.end() : end]):
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        yield name, code.count("\n", 0, start) + 1, code.count("\n", 0, end) + 1
