"""Comments of source code, line by line.

Each language is one pattern of the things that can begin outside a comment:
block delimiters, the line delimiter, and quoted text, which is skipped whole.
Quotes end with their line; blocks may go on. Blocks don't nest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Syntax(NamedTuple):
    extensions: tuple[str, ...]
    line: str
    blocks: dict[str, str]
    blocks_are_comments: bool
    quoted: str  # pattern of quoted text and of what only looks like a quote


_STRING = r'"(?:\\.|[^"\\])*(?:"|\\?$)'
# What delimits comments in each language.
SYNTAX = {
    "rust": Syntax(
        ("rs",),
        "//",
        {"/*": "*/"},
        True,
        # raw strings end at a quote and as many hashes; a tick that is no character literal is a lifetime or label
        r"[rR](?P<hashes>#*)\"(?:.*?\"(?P=hashes)|.*)|" + _STRING + r"|'(?:\\(?:[ntr\\0'\"]|x[0-9A-Fa-f]{2}|u\{[0-9A-Fa-f]*\})|[^\\])'|'",
    ),
    "python": Syntax(("py", "pyi", "pyw"), "#", {'"""': '"""', "'''": "'''"}, False, _STRING + "|" + _STRING.replace('"', "'")),
}


def _starts(syntax: Syntax) -> re.Pattern:
    blocks = "|".join(map(re.escape, syntax.blocks))
    return re.compile(rf"(?P<block>{blocks})|(?P<line>{re.escape(syntax.line)})|(?P<quoted>{syntax.quoted})", re.DOTALL)


_STARTS = {name: _starts(syntax) for name, syntax in SYNTAX.items()}


def split_lines(content: str) -> list[str]:
    """As the scanners count lines."""
    pieces = content.replace("\r\n", "\n").split("\n")
    return pieces[:-1] if pieces[-1] == "" else pieces


def comment_segments(content: str, language: str) -> Iterator[tuple[int, int, str]]:
    """(line, segment number in the line, text) of each piece of comment."""
    syntax, starts = SYNTAX[language], _STARTS[language]
    openers = (syntax.line, *syntax.blocks)
    closer = None
    for number, line in enumerate(split_lines(content), 1):
        if closer is None and not any(opener in line for opener in openers):
            continue
        at = segment = 0
        while at <= len(line):
            if closer is not None:
                end = line.find(closer, at)
                if syntax.blocks_are_comments:
                    yield number, segment, line[at:] if end < 0 else line[at:end]
                    segment += 1
                if end < 0:
                    break
                at, closer = end + len(closer), None
                continue
            begun = next((m for m in starts.finditer(line, at) if m.lastgroup != "quoted" and not m["quoted"]), None)
            if begun is None:
                break
            if begun["line"]:
                yield number, segment, line[begun.end() :]
                break
            closer, at = syntax.blocks[begun["block"]], begun.end()
