"""Globs in the manner of ignore files, as Java and Python regular expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def regex(glob: str) -> str:
    """A glob over /-separated paths. Without a slash inside, it fits at any depth; {a,b} and [..] are alternatives."""
    anchored = "/" in glob.rstrip("/")
    body, out, depth, i = glob.lstrip("/").rstrip("/"), [], 0, 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if body.startswith("**", i) and (i == 0 or body[i - 1] == "/") and i + 2 == len(body):
            out.append(".+")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := body.find("]", i + 2)) > 0:
            inner = body[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(body):
            i += 1
            out.append("\\" + body[i] if not body[i].isalnum() else body[i])
        else:
            out.append("\\" + c if not (c.isalnum() or c in "_/") else c)
        i += 1
    return ("" if anchored else "(?:.*/)?") + "".join(out)


def in_scope(path: Column, include: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """Fits some included glob and no excluded one; folders that fit take in what is below them."""
    fits = lambda globs: reduce(lambda a, b: a | b, (path.rlike(rf"\A(?:{regex(g)})(?:/.*)?\z") for g in globs), F.lit(False))
    return fits(include) & ~fits(exclude)
