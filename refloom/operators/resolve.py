"""From names to definitions, and from positions to the definitions that cover them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions import grammar


def lookup(forward: DataFrame, name: str) -> DataFrame:
    """Definitions of one whole name: a pushed filter."""
    return forward.where(F.col("anchor") == name)


def with_prefix(forward: DataFrame, prefix: str) -> DataFrame:
    """Distinct names with a prefix, for completion."""
    return forward.where(F.col("anchor").startswith(prefix)).select("anchor").distinct()


def counts(forward: DataFrame) -> DataFrame:
    """(anchor, n): definitions counted before any join."""
    return forward.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))


def reference_counts(forward: DataFrame) -> DataFrame:
    """(ref, n): every reference that finds a definition, with how many. Definitions are read once.

    A name finds all its definitions; file#name, which ``grammar.qualifier`` parts
    at the first #, finds those in the file unless it is a name itself.
    """
    parted = (F.instr("file", "#") == 0) & (F.length("file") > 0) & (F.length("anchor") > 0)
    part = F.when(parted, F.concat("file", F.lit("#"), "anchor"))
    keys = F.array(F.struct(F.col("anchor").alias("ref"), F.lit(True).alias("whole")), F.struct(part.alias("ref"), F.lit(False).alias("whole")))
    each = forward.select(F.explode(keys).alias("k")).select("k.*").where(F.col("ref").isNotNull())
    counted = each.groupBy("ref").agg(F.count_if("whole").alias("whole"), F.count_if(~F.col("whole")).alias("part"))
    return counted.select("ref", F.when(F.col("whole") > 0, F.col("whole")).otherwise(F.col("part")).alias("n"))


def count_definitions(refs: DataFrame, forward: DataFrame, ref_col: str = "anchor") -> DataFrame:
    """Add n_defs: definitions of the whole name or, if there are none, of the name in the qualifying file; null for no name.

    Definitions are counted down to one row a reference before they meet, so a
    name that a third of the references share is left to AQE's skew handling.
    """
    found = reference_counts(forward).select(F.col("ref").alias("_ref"), F.col("n").alias("_n"))
    n = F.when(F.col(ref_col).isNotNull(), F.coalesce("_n", F.lit(0)))
    return refs.join(found, refs[ref_col] == found["_ref"], "left").withColumn("n_defs", n).drop("_ref", "_n")


def resolve(refs: DataFrame, forward: DataFrame, ref_col: str = "ref") -> DataFrame:
    """A row for each reference and definition: the columns of refs, then anchor, file, start_line, end_line (null if there is none).

    Definitions are read once: a reference asks for its whole name and, if it is
    qualified, for the name in the file too, which counts if the first finds none.
    """
    q = grammar.qualifier(F.col("_ref"))
    ask = lambda rank, name, file: F.struct(F.lit(rank).alias("rank"), name.alias("name"), file.alias("in_file"))
    names = refs.select(F.col(ref_col).alias("_ref")).distinct()
    asked = names.select("_ref", F.explode(F.array(ask(0, F.col("_ref"), F.lit(None).cast("string")), ask(1, q["name"], q["file"]))).alias("_a"))
    asked = asked.select("_ref", F.col("_a.rank").alias("_rank"), F.col("_a.name").alias("_name"), F.col("_a.in_file").alias("_file")).where((F.col("_rank") == 0) | F.col("_file").isNotNull())
    spots = forward.select("anchor", "file", "start_line", "end_line")
    met = asked.join(spots, (F.col("_name") == F.col("anchor")) & (F.col("_file").isNull() | (F.col("_file") == F.col("file"))))
    # only a qualified reference has two ranks to choose from; the definitions of any other stay apart, however many they are
    group = F.when(q["file"].isNull(), F.xxhash64("file", "start_line"))
    best = met.withColumn("_best", F.min("_rank").over(Window.partitionBy("_ref", group)))
    found = best.where(F.col("_rank") == F.col("_best")).select("_ref", "anchor", "file", "start_line", "end_line")
    return refs.join(found, refs[ref_col] == found["_ref"], "left").drop("_ref")


def covering(positions: DataFrame, forward: DataFrame) -> DataFrame:
    """(file, line, anchor, start_line, end_line) of every definition around a position; the file is the equi key of the interval join."""
    p, d = positions.alias("p"), forward.alias("d")
    inside = (F.col("p.file") == F.col("d.file")) & F.col("p.line").between(F.col("d.start_line"), F.col("d.end_line"))
    return p.join(d, inside).select("p.file", "p.line", "d.anchor", "d.start_line", "d.end_line")


def nest(positions: DataFrame, forward: DataFrame) -> DataFrame:
    """covering, with depth (1 the outermost) and innermost (the tightest span, all that tie)."""
    width = F.col("end_line") - F.col("start_line")
    by = Window.partitionBy("file", "line")
    outer = by.orderBy(width.desc(), "start_line", "anchor")
    inner = by.orderBy(width, F.col("start_line").desc())
    return covering(positions, forward).withColumns({"depth": F.row_number().over(outer), "innermost": F.rank().over(inner) == 1})


def minimal_form(anchor: Column, file: Column, n_defs: Column) -> Column:
    """The name, with its file before it where the name alone is ambiguous."""
    return F.when(n_defs > 1, F.concat(file, F.lit("#"), anchor)).otherwise(anchor)


def locate(positions: DataFrame, forward: DataFrame, all_levels: bool = False, names: DataFrame | None = None) -> DataFrame:
    """nest, its innermost or all levels, with form and marker: what to write to refer to the definition.

    ``names`` are the definitions that decide whether a name is ambiguous, if ``forward`` holds only some files'.
    """
    found = nest(positions, forward)
    found = found if all_levels else found.where("innermost")
    named = found.join(counts(forward if names is None else names), "anchor")
    form = minimal_form(F.col("anchor"), F.col("file"), F.col("n"))
    return named.withColumn("form", form).withColumn("marker", grammar.wrap(F.col("form"))).drop("n")


def search_filter(anchor: Column, want: str) -> Column:
    """An unqualified name matches markers qualified or not; a qualified one matches exactly."""
    exact = anchor == want
    return exact if "#" in want else exact | (grammar.qualifier(anchor)["file"].isNotNull() & (grammar.qualifier(anchor)["name"] == want))


#: Definitions sampled for each range of the index's order, and the sample's seed.
SAMPLED, SEED = 32, 42


def _range(bounds: list[tuple[str, str]]) -> Column:
    """How many bounds, which ascend, are at most (anchor, location): first among every k-th, then within its stretch."""
    if not bounds:
        return F.lit(0)
    k = math.isqrt(len(bounds))
    spots = lambda some: F.array(*[F.struct(F.lit(a).alias("anchor"), F.lit(b).alias("location")) for a, b in some])
    at_most = lambda some: F.size(F.filter(some, lambda b: (b["anchor"] < F.col("anchor")) | ((b["anchor"] == F.col("anchor")) & (b["location"] <= F.col("location")))))
    stretches = F.array(*[spots(bounds[i : i + k]) for i in range(0, len(bounds), k)])
    # the stretch before the first heading that is above the key
    before = F.greatest(at_most(spots(bounds[::k])) - 1, F.lit(0))
    return before * k + at_most(F.get(stretches, before))


def places(forward: DataFrame) -> DataFrame:
    """(anchor, location) of each definition."""
    return forward.select("anchor", grammar.location(F.col("file"), F.col("start_line"), F.col("end_line")).alias("location"))


def ordered(forward: DataFrame) -> DataFrame:
    """(anchor, location, position): all definitions numbered in canonical order, by anchor and then location.

    Ranges of (anchor, location) are numbered by themselves and shifted by the
    sizes of those before, so a name that every file has spans many ranges. Their
    bounds are quantiles of a sample; wherever they lie, the numbers are the same.
    ``forward``, of which ``places`` may have been taken, is read four times, so it should be stored.
    """
    parts = int(forward.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = forward if "location" in forward.columns else places(forward)
    part = min(1.0, SAMPLED * parts / max(named.count(), 1))
    # Python orders text by code points, which is the order of its UTF-8 bytes
    sample = sorted(tuple(r) for r in named.where(F.rand(SEED) < part).collect())
    ranged = named.withColumn("range", _range([sample[i * len(sample) // parts] for i in range(1, parts)] if sample else []))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("range").orderBy("anchor", "location"))
    return ranged.withColumn("own", own).join(F.broadcast(ahead), "range").select("anchor", "location", (F.col("ahead") + F.col("own")).alias("position"))
