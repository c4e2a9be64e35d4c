"""Definitions (anchors) with the lines they cover.

Markdown headings and Gherkin titles are sections: each runs to the line before
the next title of the same or a higher rank. Python and Rust symbols cover their
whole item.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.functions import grammar
from refloom.operators.lines import given_extension, visible_lines
from refloom.operators.symbols import python_symbols, rust_symbols

MARKDOWN, GHERKIN, RUST, PYTHON = ("md", "markdown"), ("feature",), ("rs",), ("py", "pyi", "pyw")
DEEPEST = 7
_DOCSTRING = r"(?U)\A\s*(\"\"\"|```)"
# CommonMark's fence: up to three blanks, three ticks or tildes or more
_BLOCK_FENCE = r"\A {0,3}(```|~~~)"
_HEADING = r"\A {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\z"
# Gherkin's titles, with their ranks.
GHERKIN_RANKS = {"Feature": 1, "Rule": 2, "Scenario Outline": 3, "Scenario": 3, "Example": 3}
_TITLE = rf"(?U)\A\s*({'|'.join(GHERKIN_RANKS)}):"
FORWARD = T.StructType([T.StructField("anchor", T.StringType()), T.StructField("file", T.StringType()), T.StructField("start_line", T.LongType()), T.StructField("end_line", T.LongType())])


def markdown_titles(files: DataFrame) -> DataFrame:
    """(path, line, title, rank, total): ATX headings outside fenced and indented code; total is the file's number of lines."""
    seen = visible_lines(files, _BLOCK_FENCE, lambda text: text.rlike(_HEADING))
    title = grammar.trim(F.regexp_extract("text", _HEADING, 2))
    return seen.select("path", "line", title.alias("title"), F.length(F.regexp_extract("text", _HEADING, 1)).alias("rank"), "total").where(title != "")


def gherkin_titles(files: DataFrame) -> DataFrame:
    """(path, line, title, rank, total) outside docstrings."""
    seen = visible_lines(files, _DOCSTRING, lambda text: text.rlike(_TITLE))
    keyword = F.regexp_extract("text", _TITLE, 1)
    rank = F.when(keyword == "Feature", 1).when(keyword == "Rule", 2).otherwise(3)
    title = grammar.trim(F.regexp_replace("text", _TITLE, ""))
    return seen.select("path", "line", title.alias("title"), rank.alias("rank"), "total").where(title != "")


def sections(titles: DataFrame, ranks: int) -> DataFrame:
    """Replace total by end_line: before the next title of rank at most one's own, or the last line."""
    # from the last title backwards, so that each frame grows by a row instead of being summed anew
    later = Window.partitionBy("path").orderBy(F.col("line").desc()).rowsBetween(Window.unboundedPreceding, -1)
    end: Column = F.lit(None).cast("bigint")
    for k in range(ranks, 0, -1):
        end = F.when(F.col("rank") == k, F.min(F.when(F.col("rank") <= k, F.col("line"))).over(later)).otherwise(end)
    return titles.withColumn("_next", end).withColumn("end_line", F.coalesce(F.col("_next") - 1, F.greatest("total", "line"))).drop("_next", "total")


def _section_anchors(titles: DataFrame, ranks: int, records: bool) -> DataFrame:
    name = F.coalesce(grammar.record_id(F.col("title")), F.col("title")) if records else F.col("title")
    return sections(titles, ranks).select(name.alias("anchor"), F.col("path").alias("file"), F.col("line").alias("start_line"), "end_line")


def _symbols(files: DataFrame, find) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(name, path, start, end) for path, content in zip(pdf["path"], pdf["content"], strict=True) for name, start, end in find(content)]
            yield pd.DataFrame(rows, columns=FORWARD.names)

    return files.select("path", "content").mapInPandas(read, FORWARD)


#: Language: its extensions and how a frame of its files becomes anchors. Further ones may be registered.
LANGUAGES = {
    "markdown": (MARKDOWN, lambda f: _section_anchors(markdown_titles(f), DEEPEST, True)),
    "gherkin": (GHERKIN, lambda f: _section_anchors(gherkin_titles(f), 3, False)),
    "rust": (RUST, lambda f: _symbols(f, rust_symbols)),
    "python": (PYTHON, lambda f: _symbols(f, python_symbols)),
}


def anchors(files: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """(anchor, file, start_line, end_line, language) of every definition. Files without content have none.

    ``files`` has (path, content), and may have extension.
    """
    out = None
    for name in languages or tuple(LANGUAGES):
        extensions, read = LANGUAGES[name]
        own = files.where(given_extension(files, grammar.path_extension).isin(*extensions) & F.col("content").isNotNull())
        part = read(own).withColumn("language", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
