"""From files to lines to the segments that are scanned."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.functions import grammar
from refloom.operators.comments import SYNTAX, comment_segments

_FENCE = r"(?U)\A\s*(```|~~~)"
_SPAN = r"(?s)(?<!`)(`++)(.+?)(?<!`)\1(?!`)"
MARKDOWN = ("md", "markdown")


def line_array(content: Column) -> Column:
    """Lines without their ends; \\r goes only before \\n, and a last empty piece is no line."""
    without = lambda n: F.left(content, F.length(content) - n)
    body = F.when(content.endswith("\r\n"), without(2)).when(content.endswith("\n"), without(1)).otherwise(content)
    return F.when(F.coalesce(content, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, "\r?\n"))


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text) of every line, numbered from 1."""
    return files.select("path", F.posexplode(line_array(F.col("content"))).alias("i", "text")).select("path", (F.col("i") + 1).cast("bigint").alias("line"), "text")


def closed_regions(all_lines: Column, opener: str) -> Column:
    """Array of (first, last), indices of lines hidden by delimiters: the same delimiter closes what it opened.

    ``opener`` is a pattern whose group 1 is the delimiter. Only delimiter lines are folded over.
    """
    at = F.transform(all_lines, lambda text, i: F.struct(i.alias("i"), F.regexp_extract(text, opener, 1).alias("d")))
    marks = F.filter(at, lambda x: x["d"] != "")
    kind = "struct<d:string,i:int,out:array<struct<first:int,last:int>>>"
    start = F.struct(F.lit("").alias("d"), F.lit(0).alias("i"), F.array().alias("out")).cast(kind)

    def step(a: Column, x: Column) -> Column:
        opened = F.struct(x["d"].alias("d"), x["i"].alias("i"), a["out"].alias("out")).cast(kind)
        done = F.array(F.struct(a["i"].alias("first"), x["i"].alias("last")))
        closed = F.struct(F.lit("").alias("d"), F.lit(0).alias("i"), F.concat(a["out"], done.cast("array<struct<first:int,last:int>>")).alias("out")).cast(kind)
        return F.when(a["d"] == "", opened).when(a["d"] == x["d"], closed).otherwise(a)

    rest = lambda a: F.when(a["d"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["i"].alias("first"), F.lit(2**31 - 1).alias("last")))))
    return F.aggregate(marks, start, step, rest)


def visible_lines(files: DataFrame, opener: str = _FENCE, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, line, text, total) outside the regions that ``opener`` delimits, delimiters left out too; total is the file's number of lines.

    ``keep`` says of a text whether its line is wanted. It is asked before lines become rows.
    """
    cut = files.select("path", line_array(F.col("content")).alias("all")).withColumn("hidden", closed_regions(F.col("all"), opener))
    at = F.transform("all", lambda text, i: F.struct(i.alias("i"), text.alias("text")))
    at = at if keep is None else F.filter(at, lambda x: keep(x["text"]))
    seen = F.filter(at, lambda x: ~F.exists("hidden", lambda h: x["i"].between(h["first"], h["last"])))
    # the outer kind of explode, for Catalyst infers no filter from it and so doesn't repeat the split
    each = cut.select("path", F.size("all").cast("bigint").alias("total"), F.explode_outer(seen).alias("at")).where(F.col("at").isNotNull())
    return each.select("path", (F.col("at.i") + 1).cast("bigint").alias("line"), "at.text", "total")


def given_extension(files: DataFrame, of_path: Callable[[Column], Column]) -> Column:
    """The column extension, where the source knows it: a constant of each part of a union, so that Catalyst drops whole parts. Else by the path."""
    return F.col("extension") if "extension" in files.columns else of_path(F.col("path"))


def host(ext: Column, scan: Mapping[str, Sequence[str]]) -> Column:
    """markdown, the name of a language of which comments are read, or plain."""
    out = F.when(ext.isin(*MARKDOWN), "markdown")
    for language, eligible in scan.items():
        if "comments" in eligible and language in SYNTAX:
            out = out.when(ext.isin(*SYNTAX[language].extensions), language)
    return out.otherwise("plain")


def _markdown_segments(files: DataFrame, keep: Callable[[Column], Column] | None) -> DataFrame:
    seen = visible_lines(files, keep=keep)
    ticked = F.instr("text", "`") > 0
    spans = F.when(ticked, F.regexp_extract_all("text", F.lit(_SPAN), F.lit(2))).otherwise(F.array().cast("array<string>"))
    # a line holds no \n, so it can stand for a span between the prose pieces
    prose = F.when(ticked, F.split(F.regexp_replace("text", _SPAN, "\n"), "\n")).otherwise(F.array("text"))
    part = lambda c, odd: F.transform(c, lambda t, i: F.struct((i * 2 + odd).alias("segment_no"), F.lit(bool(odd)).alias("is_span"), t.alias("text")))
    return seen.select("path", "line", F.explode(F.concat(part(prose, 0), part(spans, 1))).alias("s")).select("path", "line", "s.segment_no", "s.is_span", "s.text")


_SEGMENT = T.StructType([T.StructField("path", T.StringType()), T.StructField("line", T.LongType()), T.StructField("segment_no", T.IntegerType()), T.StructField("is_span", T.BooleanType()), T.StructField("text", T.StringType())])


def _comment_segments(files: DataFrame, language: str) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(path, line, no, False, text) for path, content in zip(pdf["path"], pdf["content"], strict=True) if content is not None for line, no, text in comment_segments(content, language)]
            yield pd.DataFrame(rows, columns=_SEGMENT.names)

    return files.select("path", "content").mapInPandas(read, _SEGMENT)


def segments(files: DataFrame, scan: Mapping[str, Sequence[str]] | None = None, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, line, segment_no, is_span, text): everything the scanners read, under each file's region rules.

    Of Markdown, lines whose whole text ``keep`` denies are left out before they are parted.
    """
    scan = scan or {}
    hosted = files.select("path", "content", host(given_extension(files, grammar.text_extension), scan).alias("host"))
    plain = lines(hosted.where("host = 'plain'")).select("path", "line", F.lit(0).alias("segment_no"), F.lit(False).alias("is_span"), "text")
    out = _markdown_segments(hosted.where("host = 'markdown'"), keep).unionByName(plain)
    for language, eligible in scan.items():
        if "comments" in eligible and language in SYNTAX:
            out = out.unionByName(_comment_segments(hosted.where(F.col("host") == language), language))
    return out
