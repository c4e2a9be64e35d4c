"""Text and JSON forms of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions import grammar


def envelope(command: str, data: Column) -> Column:
    """The versioned JSON document around a command's data."""
    return F.to_json(F.struct(F.lit("rr-json").alias("format"), F.lit(1).alias("version"), F.lit(command).alias("command"), data.alias("data")))


def place(file: Column, start: Column, end: Column) -> Column:
    return F.struct(file.alias("file"), start.alias("start_line"), end.alias("end_line"))


def document(rows: DataFrame, command: str, name: str, entry: Column, order: list[str]) -> DataFrame:
    """(json): one document for a command's whole answer, {name: [entry, ...]} in ``order``; an empty answer has an empty list."""
    placed = F.array_sort(F.collect_list(F.struct(*order, entry.alias("_entry"))))
    return rows.agg(placed.alias("_all")).select(envelope(command, F.struct(F.transform("_all", lambda r: r["_entry"]).alias(name))).alias("json"))


def verify_document(findings: DataFrame) -> DataFrame:
    return document(findings, "verify", "findings", F.struct("file", "line", F.col("text").alias("rule")), ["file", "line", "segment_no", "class", "pos"])


def at_document(found: DataFrame) -> DataFrame:
    entry = F.struct(F.col("form").alias("anchor"), "marker", place(F.col("file"), F.col("start_line"), F.col("end_line")).alias("location"))
    return document(found, "at", "anchors", entry, ["depth"])


def count_line(n: int, what: str) -> str:
    """What follows the lines of search and verify."""
    return f"{n} {what}"


def finding_lines(findings: DataFrame) -> DataFrame:
    """file:line: rule: detail."""
    return findings.select("file", "line", "segment_no", "class", "pos", F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(": "), "text", F.lit(": "), "detail").alias("out"))


def hit_lines(hits: DataFrame) -> DataFrame:
    """file:line: marker or path."""
    return hits.select("file", "line", "segment_no", "class", "pos", F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.coalesce("raw", "token")).alias("out"))


def location_lines(found: DataFrame) -> DataFrame:
    return found.select(grammar.location(F.col("file"), F.col("start_line"), F.col("end_line")).alias("out"))
