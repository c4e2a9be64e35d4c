"""The reference grammar as Column expressions.

A marker is the opener, an escaped name and ``]]``, on one line. A name escapes
``\\``, ``[`` and ``]`` with a backslash and holds no tab or line end. A mention
is a path of two segments or more, written in prose.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker's delimiters, and what a name may hold.
OPENER, CLOSER = "[[rr:", "]]"
BODY = r"(?:\\[\\\[\]]|[^\\\]\[\t\n\r])*"

_OPEN = r"\[\[rr:"
MARKER = rf"{_OPEN}{BODY}\]\]"
MALFORMED = rf"{_OPEN}(?!{BODY}\]\])"
_LONGEST_BODY = rf"\A{_OPEN}(?:\\[\\\[\]]|[^\\\]\[\t\n\r])*+"
# a whole run of path characters; those without a slash are no paths and are passed over
TOKEN = r"(?<![A-Za-z0-9._/\-])([A-Za-z0-9._\-]*+/[A-Za-z0-9._/\-]*+(?::(?=[0-9]))?)"

# The reasons given for a malformed marker.
REASONS = {
    "unterminated": "unterminated [[rr: marker",
    "dangling": "marker ends in a dangling backslash",
    "escape": "undefined escape in marker (only \\[ \\] \\\\ exist)",
    "close": "unescaped ] in marker body",
    "open": "unescaped [ in marker body",
    "control": "control character in marker body",
}


def escape(name: Column) -> Column:
    return F.regexp_replace(name, r"([\\\[\]])", r"\\$1")


def unescape(body: Column) -> Column:
    return F.regexp_replace(body, r"\\([\\\[\]])", "$1")


def wrap(name: Column) -> Column:
    """The marker for a name."""
    return F.concat(F.lit(OPENER), escape(name), F.lit(CLOSER))


def name_of(marker: Column) -> Column:
    """The name in a well-formed marker."""
    return unescape(F.substring(marker, F.lit(len(OPENER) + 1), F.length(marker) - len(OPENER) - len(CLOSER)))


def is_marker(token: Column) -> Column:
    return token.rlike(rf"\A{MARKER}\z")


def kind_of(token: Column) -> Column:
    """bare, marker or malformed, for a whole token."""
    return F.when(~token.startswith(OPENER), "bare").when(is_marker(token), "marker").otherwise("malformed")


def reason(text: Column) -> Column:
    """Why the text, which begins with an opener, has no well-formed marker there; null if it has one."""
    rest = F.regexp_replace(text, _LONGEST_BODY, "")
    return (
        F.when(rest == "", REASONS["unterminated"])
        .when(rest == "\\", REASONS["dangling"])
        .when(rest.startswith("\\"), REASONS["escape"])
        .when(rest.startswith(CLOSER), F.lit(None))
        .when(rest.startswith("]"), REASONS["close"])
        .when(rest.startswith("["), REASONS["open"])
        .otherwise(REASONS["control"])
    )


def is_path(token: Column) -> Column:
    """Two or more nonempty segments, none of them . or .. ."""
    return token.rlike(r"\A[^/]+(?:/[^/]+)+\z") & ~token.rlike(r"(?:\A|/)\.{1,2}(?:/|\z)")


def qualifier(ref: Column) -> Column:
    """Struct (file, name): parted at the first #, if both sides hold something; else file is null."""
    at = F.instr(ref, "#")
    parted = (at > 1) & (at < F.length(ref))
    return F.struct(
        F.when(parted, F.substring(ref, F.lit(1), at - 1)).alias("file"),
        F.when(parted, F.substring(ref, at + 1, F.length(ref))).otherwise(ref).alias("name"),
    )


def reference(token: Column) -> Column:
    """The name that a bare token or a marker refers to; null for a malformed one."""
    return F.when(kind_of(token) == "bare", token).when(is_marker(token), name_of(token))


def location(file: Column, start: Column, end: Column) -> Column:
    return F.concat(file, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def parse_location(text: Column) -> Column:
    """Struct (file, start_line, end_line) of file:start-end, with nulls if it isn't one."""
    form = r"\A(?s)(.*):([0-9]+)-([0-9]+)\z"
    part = lambda i: F.regexp_extract(text, form, i)
    return F.struct(
        F.when(part(2) != "", part(1)).alias("file"),
        F.when(part(2) != "", part(2)).try_cast("bigint").alias("start_line"),
        F.when(part(3) != "", part(3)).try_cast("bigint").alias("end_line"),
    )


def parse_position(text: Column) -> Column:
    """Struct (file, line) of file:line; \\ in the file becomes /."""
    form = r"\A(?s)(.+):([0-9]+)\z"
    line = F.regexp_extract(text, form, 2)
    return F.struct(F.when(line != "", unix_path(F.regexp_extract(text, form, 1))).alias("file"), F.when(line != "", line).try_cast("bigint").alias("line"))


def unix_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def trim(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def record_id(title: Column) -> Column:
    """The ID before a title's first colon, else null."""
    found = F.regexp_extract(title, r"\A([A-Z][A-Z0-9]*-[0-9]+):", 1)
    return F.when(found != "", found)


def path_extension(path: Column) -> Column:
    """Of the file's name: what follows its last dot, unless that is its first character."""
    found = F.regexp_extract(path, r"[^/]\.([^./]*)\z", 1)
    return F.when(found != "", found)


def text_extension(path: Column) -> Column:
    """As the scanners see it: what follows the last dot of the whole path, or all of it."""
    return F.regexp_extract(path, r"(?s)([^.]*)\z", 1)
