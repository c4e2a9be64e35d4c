"""The gate: findings over the references that files write."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.functions import grammar
from refloom.operators.resolve import reference_counts
from refloom.operators.scan import hits

# The names of the findings, and how each is worded.
RULES = {
    "malformed-marker": "malformed marker",
    "dangling-marker": "dangling marker",
    "ambiguous-marker": "ambiguous marker",
    "path-only-marker": "path-only marker",
    "path-line": "bare path:line reference",
    "stale-mention": "stale path mention",
}


def check_rules(rules: Sequence[str]) -> None:
    for name in rules:
        if name not in RULES:
            raise ValueError(f"unknown verify rule: {name}")


def findings(files: DataFrame, forward: DataFrame, entries: DataFrame, rules: Sequence[str] = tuple(RULES), scan: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(file, line, segment_no, class, pos, rule, text, detail), to be read in the order of the first five.

    ``entries`` (path, is_dir) is all that exists. A mention is judged only if its
    first segment is a directory there.
    """
    check_rules(rules)
    asked = lambda *names: bool({*names} & {*rules})
    count, look = asked("dangling-marker", "ambiguous-marker"), asked("stale-mention")
    kind, is_mention = F.col("hit"), F.col("hit") == "mention"
    path_only = (F.instr("anchor", "/") > 0) & ~F.contains(F.col("anchor"), F.lit("#")) & grammar.is_path(F.col("anchor"))
    seen = F.when(kind == "malformed", "malformed-marker").when((kind == "marker") & path_only, "path-only-marker").when(is_mention & F.col("line_ref"), "path-line")
    found = hits(files, scan).withColumn("_seen", seen)
    open_ones = F.col("_seen").isNull() & ((F.lit(count) & (kind == "marker")) | (F.lit(look) & is_mention))
    found = found.where((F.col("_seen").isin(*rules) if rules else F.lit(False)) | open_ones)
    if look or asked("path-line"):
        # a first segment is a folder of the top, and those are few
        top = F.broadcast(entries.where(F.col("is_dir") & (F.instr("path", "/") == 0)).select(F.col("path").alias("_dir")).distinct())
        found = found.join(top, is_mention & (F.substring_index("token", "/", 1) == F.col("_dir")), "left").where(~is_mention | F.col("_dir").isNotNull())
    # what a marker or mention may find, in one table that hits meet once; those already judged look for nothing, spread by file
    known = None
    if count:
        known = reference_counts(forward).select(F.lit("marker").alias("_kind"), F.col("ref").alias("_key"), "n")
    if look:
        paths = entries.select(F.lit("mention").alias("_kind"), F.col("path").alias("_key"), F.lit(1).cast("bigint").alias("n")).distinct()
        known = paths if known is None else known.unionByName(paths)
    if known is None:
        found = found.withColumn("n", F.lit(None).cast("bigint"))
    else:
        of, by = F.when(F.col("_seen").isNull(), kind).otherwise("none"), F.when(F.col("_seen").isNotNull(), F.col("file")).when(is_mention, F.col("token")).otherwise(F.col("anchor"))
        found = found.withColumns({"_of": of, "_by": by}).join(known, (F.col("_of") == F.col("_kind")) & (F.col("_by") == F.col("_key")), "left")
    rule = F.when(F.col("_seen").isNotNull(), F.col("_seen")).when(is_mention, F.when(F.col("n").isNull(), "stale-mention"))
    rule = rule.when(F.col("n").isNull(), "dangling-marker").when(F.col("n") > 1, "ambiguous-marker")
    detail = F.when(is_mention, F.col("token")).when(kind == "malformed", F.col("reason")).otherwise(F.col("raw"))
    detail = F.when(F.col("rule") == "ambiguous-marker", F.concat("raw", F.lit(" resolves to "), F.col("n").cast("string"), F.lit(" definitions"))).otherwise(detail)
    out = found.withColumn("rule", rule).select("file", "line", "segment_no", "class", "pos", "rule", detail.alias("detail"))
    out = out.where(F.col("rule").isin(*rules) if rules else F.lit(False))
    wording = F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair])
    return out.withColumn("text", wording[F.col("rule")])


def entries_of(paths: DataFrame) -> DataFrame:
    """(path, is_dir) of files and all their folders, from a column path."""
    steps = F.split("path", "/")
    parents = F.when(F.size(steps) > 1, F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))
    folders = paths.select(F.explode(parents).alias("path")).distinct().withColumn("is_dir", F.lit(True))
    return paths.select("path").distinct().withColumn("is_dir", F.lit(False)).unionByName(folders)
