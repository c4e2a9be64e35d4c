"""Mixing sources to target weights by hierarchical budgets.

Documents are leaves' rows in a tree of levels (domain, language, source). A
token budget goes down the tree: each node deals its budget to its children by
weight, none beyond its capacity (unique tokens times the most epochs); what
saturated children leave is dealt among their siblings, and as a node is never
given more than its whole subtree can hold, a shortage reaches the siblings of
an ancestor only when all siblings are full. The level is found in closed form:
children in order of capacity to weight, and the first one that its share does
not fill sets the share of all after it. Budgets are whole tokens; a node may
lose less than one token for each child to rounding.

A leaf's budget is spent on whole epochs and then on a prefix of one more; every
epoch has its own seeded order (MD5 of seed, epoch and id), and the prefix holds
each document that starts inside the budget. The prefix needs no sort of a leaf:
tokens are summed by the first digits of the order key, those sums locate the
one digit group in which the budget ends, and only that group is ordered.

Defined cases: a null text has no tokens, and as a document without tokens it
is kept with whole epochs only when its leaf's prefix passes it; a null level
value is a value of its own; a null id sorts as the text "null"; weights that
are missing are 1, weights of 0 get nothing; repeated rows with one id are kept
or dropped together; an empty table gives an empty table; other columns pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.scratch import cut

#: Hex digits of the order key that make a digit group: 4096 groups a leaf.
DIGITS = 3


def tokens(text: Column) -> Column:
    """Runs of characters other than \\x20 and \\x09-\\x0D."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("bigint")


def _weight(value: Column, weights: Mapping[str, int]) -> Column:
    """A whole-number weight for a level's value; 1 where none is given."""
    out = F.lit(1).cast("bigint")
    for name, weight in weights.items():
        out = F.when(value == name, F.lit(int(weight)).cast("bigint")).otherwise(out)
    return out


def deal(children: DataFrame, parent_cols: Sequence[str], order_col: str) -> DataFrame:
    """Add ``given``: a parent's budget dealt to its children (columns budget, weight, capacity)."""
    by = Window.partitionBy(*parent_cols)
    # capacity / weight ascending; weightless children first, with nothing
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(-1.0)
    order = by.orderBy(F.col("_ratio"), F.col(order_col).asc_nulls_first())
    out = children.withColumn("_ratio", ratio).withColumn("_usable", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0).cast("bigint"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_left", F.col("budget") - F.coalesce(F.sum("_usable").over(before), F.lit(0)))
    out = out.withColumn("_rest", F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    full = F.col("_usable") * F.col("_rest") <= F.col("_left") * F.col("weight")
    out = out.withColumn("_full", full).withColumn("_n", F.row_number().over(order))
    # the first child that is not full fixes tokens and weights to share from there on
    first = F.min(F.when(~F.col("_full"), F.struct("_n", "_left", "_rest"))).over(by)
    out = out.withColumn("_first", first)
    share = F.expr("(_first._left * weight) div _first._rest")
    given = F.when(F.col("_first").isNull() | (F.col("_n") < F.col("_first._n")), F.col("_usable")).otherwise(F.least(share, F.col("_usable")))
    return out.withColumn("given", given).drop("_ratio", "_usable", "_left", "_rest", "_full", "_n", "_first")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], total: Column, max_epochs: int) -> DataFrame:
    """(levels, unique, given) for each leaf of ``leaves`` (levels, unique: its tokens); ``total`` is a column over the sum of unique."""
    capacity = (F.col("unique") * max_epochs).alias("capacity")
    leaves = leaves.select(*levels, "unique", capacity)
    above: list[str] = []
    for level in levels:
        here = [*above, level]
        sums = leaves.groupBy(*here).agg(F.sum("capacity").alias("capacity"), F.sum("unique").alias("unique")).withColumn("weight", _weight(F.col(level), weights.get(level, {})))
        if above:
            same = [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in above]
            joined = sums.alias("s").join(node.alias("n"), same)
            children = joined.select(*[F.col(f"s.{c}").alias(c) for c in [*here, "capacity", "weight"]], "n.budget")
        else:  # the root's children are the first level's few values
            children = sums.withColumn("unique", F.sum("unique").over(Window.partitionBy(F.lit(0)))).select(*here, "capacity", "weight", total.cast("bigint").alias("budget"))
        node = deal(children, above or [F.lit(0)], level).select(*here, F.col("given").alias("budget"))
        above = here
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"n.{c}")) for c in levels]
    return leaves.alias("l").join(node.alias("n"), same).select(*[F.col(f"l.{c}").alias(c) for c in [*levels, "unique"]], F.col("n.budget").alias("given"))


def _place(id_col: Column, seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"))


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], share: Sequence[int] = (1, 1), max_epochs: int = 4, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", all_rows: bool = False) -> DataFrame:
    """(id, levels, n_tokens, copies) for each row that is kept (or each row); copies counts the epochs it is in.

    The budget is share[0] / share[1] of all unique tokens. Each level is a name and the column that gives its value.
    """
    names = list(levels)
    narrow = docs.select(F.col(id_col).alias("id"), *[c.alias(n) for n, c in levels.items()], tokens(F.col(text_col)).alias("n_tokens"))
    narrow = cut(narrow, "leaves")
    given = budgets(narrow.groupBy(*names).agg(F.sum("n_tokens").alias("unique")), names, weights, F.expr(f"(unique * {int(share[0])}) div {int(share[1])}"), max_epochs)
    plan = given.select(*names, "unique", F.when(F.col("unique") > 0, F.expr("given div unique")).otherwise(0).cast("bigint").alias("whole"), F.when(F.col("unique") > 0, F.expr("given % unique")).otherwise(0).cast("bigint").alias("part"))
    plan = cut(plan, "plan")
    ties = lambda a, b: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    placed = narrow.alias("d").join(plan.alias("p"), ties("d", "p")).select("d.*", "p.whole", "p.part", _place(F.col("d.id"), seed, F.col("p.whole")).alias("place"))
    placed = placed.withColumn("digits", F.substring("place", 1, DIGITS))
    group = [*names, "digits"]
    # tokens before a digit group: a window over DIGITS' groups of a leaf, not over its rows
    ahead = Window.partitionBy(*names).orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*group, "part").agg(F.sum("n_tokens").alias("_sum")).withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    state = F.when(F.col("_ahead") >= F.col("part"), "out").when(F.col("_ahead") + F.col("_sum") <= F.col("part"), "in").otherwise("edge")
    sums = cut(sums.select(*group, "_ahead", state.alias("state")), "groups")
    gties = lambda a, b: [*ties(a, b), F.col(f"{a}.digits") == F.col(f"{b}.digits")]
    known = placed.alias("a").join(sums.alias("b"), gties("a", "b")).select("a.*", "b._ahead", "b.state")
    # rows of one id share a place: they count as one, so that a key that holds many rows is one row here
    edge = known.where(F.col("state") == "edge").groupBy(*group, "place", "part", "_ahead").agg(F.sum("n_tokens").alias("_sum"))
    within = Window.partitionBy(*group).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_before", F.col("_ahead") + F.coalesce(F.sum("_sum").over(within), F.lit(0))).where(F.col("_before") < F.col("part"))
    passed = edge.select(*group, "place", F.lit(1).alias("hit"))
    out = known.alias("k").join(passed.alias("e"), [*gties("k", "e"), F.col("k.place") == F.col("e.place")], "left")
    extra = F.when(F.col("k.state") == "in", 1).when(F.col("k.state") == "out", 0).otherwise(F.coalesce(F.col("e.hit"), F.lit(0)))
    out = out.select(F.col("k.id").alias("id"), *[F.col(f"k.{n}").alias(n) for n in names], F.col("k.n_tokens").alias("n_tokens"), (F.col("k.whole") + extra).alias("copies"))
    return out if all_rows else out.where(F.col("copies") > 0)
