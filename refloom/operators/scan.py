"""Markers, malformed openers and path mentions in segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions import grammar
from refloom.operators.lines import segments

ORDER = ("file", "line", "segment_no", "class", "pos")
_FIELDS = {"class": "int", "pos": "int", "hit": "string", "raw": "string", "anchor": "string", "reason": "string", "token": "string", "line_ref": "boolean"}
_HITS = f"array<struct<{','.join(f'{name}:{kind}' for name, kind in _FIELDS.items())}>>"


def _hit(kind: int, *values: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in zip(_FIELDS, (F.lit(kind), *values), strict=True)])


def hits(files: DataFrame, scan: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One row for each hit: file, line, segment_no, class (0 marker or malformed, 1 mention), pos, hit, raw, anchor, reason, token, line_ref.

    ORDER is the reading order. A code span counts only if it begins with a
    marker, and for one hit at most; mentions come from prose, outside markers,
    and not after a malformed opener.
    """
    # a line without either holds no hit
    parts = segments(files, scan, lambda text: (F.instr(text, grammar.OPENER) > 0) | (F.instr(text, "/") > 0)).withColumnRenamed("path", "file")
    opened = F.instr("text", grammar.OPENER) > 0
    # a piece from each opener to the next one; a line holds no \n. A marker's body holds no opener, so it is in its piece
    pieces = F.when(opened & (~F.col("is_span") | F.col("text").startswith(grammar.OPENER)), F.split(F.regexp_replace("text", r"\[\[rr:", "\n[[rr:"), "\n"))
    masked = F.when(opened, F.regexp_replace(F.regexp_replace("text", rf"(?s){grammar.MALFORMED}.*", ""), grammar.MARKER, "[]")).otherwise(F.col("text"))
    tokens = F.when(~F.col("is_span") & (F.instr("text", "/") > 0), F.regexp_extract_all(masked, F.lit(grammar.TOKEN), F.lit(1)))
    parts = parts.select("file", "line", "segment_no", "is_span", pieces.alias("pieces"), tokens.alias("tokens"))
    # patterns are matched inside the arrays, each once: what is made of a row's columns is worked out anew by every filter that is pushed down
    wanted = F.slice("pieces", F.lit(2), F.when(F.col("is_span"), 1).otherwise(F.size("pieces")))
    # what is wrong with a malformed one may be that the next opener comes
    rest = lambda piece, i: F.when(i + 2 < F.size("pieces"), F.concat(piece, F.lit(grammar.OPENER))).otherwise(piece)
    text, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    marks = F.transform(wanted, lambda piece, i: F.struct(i.alias("pos"), F.regexp_extract(piece, rf"\A{grammar.MARKER}", 0).alias("raw"), rest(piece, i).alias("rest")))
    good = lambda m, value: F.when(m["raw"] != "", value)
    marks = F.transform(marks, lambda m: _hit(0, m["pos"], good(m, F.lit("marker")).otherwise("malformed"), good(m, m["raw"]), good(m, grammar.name_of(m["raw"])), F.when(m["raw"] == "", grammar.reason(m["rest"])), text, flag))
    mentions = F.transform("tokens", lambda token, i: F.struct(i.alias("pos"), F.regexp_replace(token, r"\.*:?\z", "").alias("token"), token.endswith(":").alias("line_ref")))
    mentions = F.transform(F.filter(mentions, lambda m: grammar.is_path(m["token"])), lambda m: _hit(1, m["pos"], F.lit("mention"), text, text, text, m["token"], m["line_ref"]))
    none = F.array().cast(_HITS)
    # the outer kind of explode, for Catalyst infers no filter from it
    both = F.concat(F.coalesce(marks.cast(_HITS), none), F.coalesce(mentions.cast(_HITS), none))
    return parts.select("file", "line", "segment_no", F.explode_outer(both).alias("h")).where(F.col("h").isNotNull()).select("file", "line", "segment_no", "h.*")


def mention_table(files: DataFrame) -> DataFrame:
    """(token, file, line, line_ref): the mentions of all files, no region but Markdown's narrowed."""
    return hits(files).where("hit = 'mention'").select("token", "file", "line", "line_ref")
