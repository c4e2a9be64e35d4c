"""Benchmark decontamination by winnowing.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters.
Of the K-gram hashes in each window of WINDOW words the least is kept; two texts
that share WINDOW consecutive words share that fingerprint, so none is missed.
A run of windows with the same least hash keeps one fingerprint (and one more
every REACH windows, should the run be longer than a fingerprint reaches).
Training fingerprints are joined to those of the benchmark, and each hit is
extended: every window that the fingerprint stands for is compared word for
word with the benchmark's windows. A benchmark text of fewer words is one
window as a whole; it is anchored by the hash of its first words instead.

Everything is a DataFrame expression. Hashes of K words are built from those of
fewer words by pairing an array with itself, shifted, and sliding minima
likewise. Texts are cut into words once and kept as a table with a number for each
row. Exploded rows carry numbers only; the few rows with a hit meet their text's
words afterwards, by the row's number. The benchmark side is broadcast if it has
at most BROADCAST_ROWS windows, else both sides are shuffled by fingerprint.

Defined cases: a null or wordless text has no words, is not hit and is not
contaminated; a null or wordless benchmark text has no window and hits nothing;
equal windows of several benchmark texts count for each of them; rows are judged
one by one, whether or not their ids are null, repeated or shared by different
texts; a null item_id hits words but is not an item by name; columns beyond id
and text are not read; an empty table on either side gives rows without hits or
no rows.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.scratch import cut

WINDOW = 13
K = 6
REACH = WINDOW - K + 1
BROADCAST_ROWS = 200_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANCHORS = (1, 2, 4)


def words(text: Column) -> Column:
    """Array of words. For plain ASCII, lower() is the same as lower-casing A-Z and much faster than translate()."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lower, _SEPARATORS), "")


def _shift(c: Column, by: int) -> Column:
    # slice() wants a start inside an array that is not empty; beyond it the result is empty as it should be
    return F.slice(c, F.lit(by + 1), F.greatest(F.size(c) - by, F.lit(0)))


def _pair(c: Column, by: int, how) -> Column:
    """how(c[i], c[i + by]) for every i for which both exist."""
    n = F.greatest(F.size(c) - by, F.lit(0))
    return F.zip_with(F.slice(c, F.lit(1), n), _shift(c, by), how)


def _hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _hashed(df: DataFrame) -> DataFrame:
    """Add g1, g2, g4 (hashes of so many words of ``w``) and m (least K-gram hash of each window)."""
    out = df.withColumn("g1", F.transform("w", lambda x: F.xxhash64(x)))
    out = out.withColumn("g2", _pair(F.col("g1"), 1, _hash)).withColumn("g4", _pair(F.col("g2"), 2, _hash))
    out = out.withColumn("g6", _pair(F.col("g4"), 2, _hash))
    least = lambda a, b: F.least(a, b)
    # minima over 2, 4 and 8 = REACH hashes; a column for each, as an expression inside itself would be worked out many times
    out = out.withColumn("m2", _pair(F.col("g6"), 1, least)).withColumn("m4", _pair(F.col("m2"), 2, least))
    return out.withColumn("m", _pair(F.col("m4"), 4, least)).drop("g6", "m2", "m4")


def _phrase(w: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(w, start + 1, n), " ")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _benchmark(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each occurrence of a window: item, n (its words), anchor (words hashed; 0: least K-gram), h, phrase."""
    base = _hashed(items.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")))
    n = F.size("w")
    # the outer kind of explode: from the other one Catalyst infers a filter on the array, and inlines all it is made of
    full = base.select(F.col("id").alias("item"), "w", F.posexplode_outer("m").alias("i", "h"))
    full = full.where(F.col("h").isNotNull()).select("item", F.lit(WINDOW).alias("n"), F.lit(0).alias("anchor"), "h", _phrase(F.col("w"), F.col("i"), F.lit(WINDOW)).alias("phrase"))
    anchor = reduce(lambda c, a: F.when(n >= a, a).otherwise(c), _ANCHORS, F.lit(1))
    short = base.where((n > 0) & (n < WINDOW)).withColumn("anchor", anchor)
    first = F.when(F.col("anchor") == 1, F.get("g1", F.lit(0))).when(F.col("anchor") == 2, F.get("g2", F.lit(0))).otherwise(F.get("g4", F.lit(0)))
    return full.unionByName(short.select(F.col("id").alias("item"), n.alias("n"), "anchor", first.alias("h"), F.array_join("w", " ").alias("phrase")))


def prepare(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, text_hash, n_words, w) of every document, written once; ``row`` tells rows apart whatever their ids."""
    text = F.col(text_col)
    cutted = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_hash"), words(text).alias("w"))
    return cut(cutted, "words").withColumn("n_words", F.size("w"))


def hits(base: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, i, n, phrase): the benchmark's windows of n words that start at word i of a row of ``prepare``, each once."""
    hashed = _hashed(base)
    known = _few(windows.where("anchor = 0").select("h").distinct())
    kept = hashed.select("row", "n_words", "m", F.posexplode_outer("m").alias("i", "h"))
    kept = kept.where((F.col("i") % REACH == 0) | (F.get("m", F.col("i") - 1) != F.col("h"))).select("row", "n_words", "i", "h")
    reached = F.sequence(F.col("i"), F.least(F.col("i") + REACH - 1, F.col("n_words") - WINDOW))
    near = kept.join(known, "h").select("row", F.explode(reached).alias("i"), F.lit(WINDOW).alias("n"))
    for a in sorted(r["anchor"] for r in windows.where("anchor > 0").select("anchor").distinct().collect()):  # 1, 2 and 4 at most
        short = _few(windows.where(F.col("anchor") == a).select("h", "n").distinct())
        begun = hashed.select("row", "n_words", F.posexplode_outer(f"g{a}").alias("i", "h")).join(short, "h")
        near = near.unionByName(begun.where(F.col("i") + F.col("n") <= F.col("n_words")).select("row", "i", "n"))
    # a row's places are no more than its words; a table, so that its size is known when it meets the words
    places = cut(near.groupBy("row").agg(F.collect_set(F.struct("i", "n")).alias("places")), "places")
    few = base.select("row", "w").join(_few(places.select("row")), "row", "left_semi")
    met = few.join(places, "row")
    spoken = F.transform("places", lambda p: F.struct(p["i"].alias("i"), p["n"].alias("n"), _phrase(F.col("w"), p["i"], p["n"]).alias("phrase")))
    said = met.select("row", F.explode_outer(spoken).alias("p")).select("row", "p.i", "p.n", "p.phrase")
    return said.join(_few(windows.select("n", "phrase").distinct()), ["n", "phrase"], "left_semi").select("row", "i", "n", "phrase")


def _covered(spans: Column) -> Column:
    """Words inside the union of an array of (i, n), sorted by i."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("words"))

    def grow(acc: Column, s: Column) -> Column:
        end = s["i"] + s["n"]
        new = F.greatest(end - F.greatest(acc["end"], s["i"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["words"] + new).alias("words"))

    return F.aggregate(spans, start, grow, lambda acc: acc["words"])


def judge(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", part: int = 20) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (part * n_hit >= n_words > 0 hits), spans (i, n) and text_hash."""
    windows = cut(_benchmark(items, item_id, text_col), "windows")
    base = prepare(docs, doc_id, text_col)
    found = cut(hits(base, windows), "hits")
    # a document's spans are no more than its words
    spans = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("i", "n"))).alias("spans"))
    owners = windows.select("n", "phrase", F.col("item").cast("string").alias("item")).distinct()
    held = found.select("row", "n", "phrase").distinct().join(_few(owners), ["n", "phrase"]).where("item is not null").select("row", "item").distinct()
    named = held.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    marked = spans.join(named, "row", "left").select("row", _covered(F.col("spans")).alias("n_hit"), "n_items", "items", "spans")
    hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return base.select("row", "id", "text_hash", F.col("n_words").cast("bigint").alias("n_words")).join(marked, "row", "left").select(
        F.col("id").alias(doc_id),
        "n_words",
        hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((hit > 0) & (hit * part >= F.col("n_words"))).alias("contaminated"),
        "spans",
        "text_hash",
    )
