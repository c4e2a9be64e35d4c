"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits; a bit is set if it is set in over half the XXH64
hashes of the text's word shingles. Documents link when their fingerprints
differ in at most ``BITS`` (3) bits, and groups are the connected components.

The 64 bits are split into six blocks. Two fingerprints that differ in at most
three bits agree on at least three blocks, so they share one of the 20 keys
made of three blocks. Keys are counted with map-side combination; a key that
two fingerprints share *is* the pair (its least and greatest member). Only
keys with more members are read again. A crowded key is split by a second and
then a third partition of the 64 bits into six blocks, laid across the first:
the pigeonhole holds for each partition by itself, so no pair is lost, and the
bits left free shrink from 32 to 16 to about 8, which bounds the size of a
bucket by construction. A pair is reported only at the first key it shares, so
each link is made once. Exact copies have one fingerprint and are counted once
from the start.

``near_groups`` is the stage for near copies: texts whose sets of five-word
shingles have a Jaccard similarity of SIMILAR or more, by an exact join over
prefixes. All shingles are put in one order, common ones last; two texts that
are alike share a shingle among the first fifth (and one more) of each, since
their first common shingle has at least four fifths of either set from there on.
Any order will do, so what is common is counted on a sample. Keys are those
shingles. In a key of few texts all pairs are links; in one of many each text
first meets the least of its key. A text's nearest links are verified on the whole
sets and give groups; then *every* pair of a key whose texts are still in different
groups is verified too, crowded keys included, so no link that would join
two groups is lost, and pairs inside a group are never made.

Defined cases: a null or empty text, or one without words, has fingerprint
zero and links like any other; fewer words than a shingle make one shingle of
all words; repeated rows and repeated ids fall into one group if their
fingerprints link; a null id never becomes a group's id unless the whole group
has none; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.llm.components import components
from refloom.llm.scratch import cut, small_batches

BITS = 3
BLOCKS = 6
SEED = 42
#: Members of a bucket that are compared with each other; a larger bucket is split.
CROWD = 128
#: The stage for near copies: words of a shingle, similarity (numerator, denominator), and texts of a key that all meet at once.
SHINGLE, SIMILAR, FEW = 5, (4, 5), 8
#: One text of SAMPLE tells how common shingles are; those of COMMON sampled texts or more, MOST_COMMON at most, come last in the order.
SAMPLE, COMMON, MOST_COMMON = 8, 3, 200_000
#: Longs of a set's parity, a power of two.
PARITY = 8
#: Links of a text that are verified first.
NEAREST = 2
#: Keys of several texts that are broadcast; more are shuffled.
BROADCAST_KEYS = 1_000_000


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import xxhash

    # bytes.split() parts at exactly \x20 and \x09-\x0D; lower() of bytes changes A-Z alone
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens) - words + 1
    if not tokens:
        return 0
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)) if n > 1 else [b" ".join(tokens)]
    digest = xxhash.xxh64_intdigest
    return _majority([digest(s, SEED) for s in shingles])


def _majority(values: list[int]) -> int:
    """The bits that are set in over half the values."""
    import numpy as np

    hashes = np.array(values, dtype="<u8")
    if not len(hashes):
        return 0
    # each byte value spreads into eight byte-wide counters, 255 hashes to a counter at most
    n = len(hashes)
    padded = np.zeros(-(-n // 255) * 255, dtype="<u8")
    padded[:n] = hashes
    counts = np.concatenate([_spread()[column].reshape(-1, 255).sum(axis=1, dtype="<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64) for column in padded.view(np.uint8).reshape(-1, 8).T])
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


_SPREAD: list = []


def _spread():
    """For each byte, its bits as the bytes of one 64-bit word."""
    if not _SPREAD:
        import numpy as np

        _SPREAD.append(np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").copy().view("<u8").ravel())
    return _SPREAD[0]


@F.pandas_udf(T.LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        values = [fingerprint(t) for t in texts]
        yield pd.Series([v - (1 << 64) if v >> 63 else v for v in values], dtype="int64")


def _shingle_hashes(words: list[bytes]):
    """The hashes of the distinct shingles of SHINGLE words, ascending; of fewer words, the one of them all."""
    import numpy as np
    import xxhash

    rows = [b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)] or [b" ".join(words)]
    return np.unique(_as_long([xxhash.xxh64_intdigest(r, SEED) for r in rows]))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        for lo in range(0, len(texts), 256):
            yield pd.Series([_shingle_hashes((t or "").encode("utf-8", "surrogatepass").lower().split()).tolist() for t in texts.iloc[lo : lo + 256]])


_PROFILE = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("parity", T.ArrayType(T.LongType()))])


def _profiles(common, times):
    """A hash of a text's words in order, the size of its set of shingles, the set's prefix in the order of (times, hash), and the
    set's parity: 64 * PARITY bits, each of which a shingle of that remainder turns."""
    import numpy as np

    top, bottom = SIMILAR

    @F.pandas_udf(_PROFILE)
    def profiles(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for texts in batches:
            nodes, sizes, keys, parity = [], [], [], []
            for t in texts:  # one text's words at a time
                words = (t or "").encode("utf-8", "surrogatepass").lower().split()
                nodes.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
                s = _shingle_hashes(words)
                rank = np.zeros(len(s), dtype=np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    rank = np.where(common[at] == s, times[at], 0)
                sizes.append(len(s))
                keys.append(s[np.lexsort((s, rank))[: len(s) + 1 + (-top * len(s)) // bottom]].tolist())
                turned = np.bincount(s & (64 * PARITY - 1), minlength=64 * PARITY) & 1
                parity.append(np.packbits(turned.astype(np.uint8), bitorder="little").view("<i8").tolist())
            yield pd.DataFrame({"node": _as_long(nodes), "n": sizes, "keys": keys, "parity": parity})

    return profiles


def _as_long(values: list[int]):
    import numpy as np

    return np.array(values, dtype=np.uint64).view(np.int64)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _partitions(blocks: int, taken: int) -> list[list[int]]:
    """Three lists of masks of ``taken`` blocks; each partition's blocks cut across those of the ones before."""
    small = [i * blocks // 64 for i in range(64)]
    across = [i % blocks for i in range(64)]
    slant = [(i % blocks + i // blocks) % blocks for i in range(64)]
    out = []
    for block in (small, across, slant):
        parts = [sum(1 << i for i in range(64) if block[i] == b) for b in range(blocks)]
        out.append([_signed(sum(parts[b] for b in chosen)) for chosen in combinations(range(blocks), taken)])
    return out


PARTITIONS = _partitions(BLOCKS, BLOCKS - BITS)


def _near(lo: Column, hi: Column) -> Column:
    return F.bit_count(lo.bitwiseXOR(hi)) <= BITS


def _first(lo: Column, hi: Column, level: int) -> Column:
    """The first key of the partition that both share."""
    differ = lo.bitwiseXOR(hi)
    out = F.lit(None).cast("int")
    for k, mask in reversed(list(enumerate(PARTITIONS[level]))):
        out = F.when(differ.bitwiseAND(F.lit(mask)) == 0, k).otherwise(out)
    return out


def _keyed(members: DataFrame, level: int) -> DataFrame:
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in PARTITIONS[level]]))
    return members.select("*", keys.alias(f"k{level}", f"key{level}"))


def links(fingerprints: DataFrame) -> DataFrame:
    """Pairs (lo, hi), lo < hi, of distinct values of column ``fp`` that differ in at most BITS bits, each once."""
    members, path, found = fingerprints.select("fp").distinct(), [], []
    lo, hi = F.col("lo"), F.col("hi")
    for level in range(len(PARTITIONS)):
        path += [f"k{level}", f"key{level}"]
        keyed = _keyed(members, level)
        shared = cut(keyed.groupBy(*path).agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"), "keys")

        def first(k=level):
            out = F.lit(True)
            for i in range(k + 1):
                out = out & (F.col(f"k{i}") == _first(lo, hi, i))
            return out

        found.append(shared.where(F.col("n") == 2).where(_near(lo, hi) & first()).select("lo", "hi"))
        several = shared.where(F.col("n") > 2)
        if several.isEmpty():
            break
        last = level == len(PARTITIONS) - 1
        grouped = cut(keyed.join(several.select(*path, "n"), path), "members")
        small = grouped if last else grouped.where(F.col("n") <= CROWD)
        left, right = small.select(*path, F.col("fp").alias("lo")), small.select(*path, F.col("fp").alias("hi"))
        found.append(left.join(right, [left[c] == right[c] for c in path] + [lo < hi, _near(lo, hi), *[left[f"k{i}"] == _first(lo, hi, i) for i in range(level + 1)]]).select("lo", "hi"))
        members = grouped.where(F.col("n") > CROWD).drop("n")
        if last or members.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): a row for each row of ``docs``; component_id is the least id of the group."""
    own = cut(docs.select(F.col(id_col).alias("id"), _fingerprints(F.col(text_col)).alias("fp")), "fingerprints")
    distinct = cut(own.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(distinct), "lo", "hi").withColumnRenamed("node", "fp")
    rooted = cut(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return own.join(classes, "fp").select("id", "fp", "component_id")


def hex_digits(fp: Column | str) -> Column:
    """The 16 lowercase hex digits of a fingerprint held as a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _common(docs: DataFrame, text_col: str):
    """(hashes ascending, sampled texts that have each) of the commonest shingles of a sample of distinct texts."""
    import numpy as np

    drawn = docs.select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("x")).where(F.pmod("x", F.lit(SAMPLE)) == 0)
    each = drawn.groupBy("x").agg(F.first("t").alias("t")).select(F.explode(_shingles("t")).alias("h"))
    counted = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    with small_batches(docs.sparkSession):
        found = counted.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    hashes, times = found["h"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    return hashes[order], times[order]


def _profiled(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, doc, node, n, keys, parity) of every row, written once; ``row`` tells rows apart whatever their ids, ``doc`` holds all their columns."""
    profiles = _profiles(*_common(docs, text_col))
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), profiles(F.col(text_col)).alias("p"))
    with small_batches(docs.sparkSession):
        return cut(own.select("row", "doc", "p.*"), "profiles")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, root): a row for each row of ``docs``; rows of one root are near copies of each other, through others too."""
    return _grouped(_profiled(docs, text_col), id_col, text_col)


def _sized(a: str, b: str) -> Column:
    """Sets of these sizes can be alike."""
    top, bottom = SIMILAR
    return (F.col(a) * bottom >= F.col(b) * top) & (F.col(b) * bottom >= F.col(a) * top)


def _pairs(pairs: DataFrame) -> DataFrame:
    """(lo, hi, shared): each pair once, with the number of keys it was found in."""
    return pairs.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("shared"))


def _met(keyed: DataFrame, *more: Column) -> DataFrame:
    """(lo, hi) of the texts of each key of ``keyed`` (h, node, n, pos) that can be alike if they share nothing before that key.

    They share at most what either has from the key on; the first key of texts that are alike leaves them enough.
    """
    top, bottom = SIMILAR
    left = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    enough = left * (top + bottom) >= (F.col("a.n") + F.col("b.n")) * top
    pair = [F.col("a.h") == F.col("b.h"), F.col("a.node") < F.col("b.node"), _sized("a.n", "b.n"), enough, *more]
    return keyed.alias("a").join(keyed.alias("b"), pair).select(F.col("a.node").alias("lo"), F.col("b.node").alias("hi"))


def _key_links(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lo, hi, shared): the pairs of keys with few texts, and in the others each text with the least; and the rows (h, node, n, pos) of the others."""
    keyed = own.select(F.posexplode("keys").alias("pos", "h"), "node", "n")
    # most keys are of one text: keys are told first, and only rows of the others move
    shared = cut(keyed.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("h"), "shared")
    held = F.broadcast(shared) if shared.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else shared
    keyed = cut(keyed.join(held, "h", "left_semi").distinct(), "keyed")
    sizes = cut(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("node", "n")).alias("least")), "keys")
    grouped = cut(keyed.join(sizes, "h"), "members")
    crowd = grouped.where(F.col("m") > FEW)
    stars = crowd.where((F.col("node") != F.col("least.node")) & _sized("n", "least.n")).select(F.col("least.node").alias("lo"), F.col("node").alias("hi"))
    few = grouped.where(F.col("m") <= FEW).select("h", "node", "n", "pos")
    return cut(_pairs(_met(few).union(stars)), "links"), crowd.select("h", "node", "n", "pos")


def _apart(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``links`` whose ends are in different groups, with the groups (lo_root, hi_root)."""
    for c in ("lo", "hi"):
        links = links.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    return links.where("lo_root <> hi_root")


def _crowd_links(crowd: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame:
    """(lo, hi): all pairs of crowded keys whose texts are in different groups; keys of one group have nothing to add.

    Two sets differ in as many shingles as their parities in bits, at least, so pairs that differ too much are not made.
    """
    top, bottom = SIMILAR
    parity = [f"p{i}" for i in range(PARITY)]
    told = crowd.join(members.select("node", *parity), "node").join(roots, "node", "left")
    rooted = cut(told.withColumn("root", F.coalesce("root", "node")), "rooted")
    differ = sum((F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in parity), F.lit(0))
    close = differ * (bottom + top) <= (F.col("a.n") + F.col("b.n")) * (bottom - top)
    mixed = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    return _met(cut(rooted.join(mixed, "h", "left_semi"), "mixed"), F.col("a.root") != F.col("b.root"), close).distinct()


def _grouped(own: DataFrame, id_col: str, text_col: str) -> DataFrame:
    links, crowd = _key_links(own)
    own = own.select("row", "node", "parity", F.col("doc")[id_col].alias("id"), F.col("doc")[text_col].alias("text"))
    members = cut(own.groupBy("node").agg(F.min("row").alias("row"), *[F.min(F.col("parity")[i]).alias(f"p{i}") for i in range(PARITY)]), "texts")
    rank = F.row_number().over(Window.partitionBy("hi").orderBy(F.desc("shared"), "lo"))
    near = cut(links.withColumn("rank", rank).where(F.col("rank") <= NEAREST).select("lo", "hi"), "nearest")
    roots = cut(components(_alike(own, members, near), "lo", "hi"), "roots")
    rest = _apart(links.select("lo", "hi"), roots).select("lo", "hi").union(_apart(_crowd_links(crowd, members, roots), roots).select("lo", "hi")).distinct()
    rest = cut(rest.join(near, ["lo", "hi"], "left_anti"), "rest")
    if not rest.isEmpty():
        joined = components(_apart(_alike(own, members, rest), roots), "lo_root", "hi_root")
        again = joined.select(F.col("node").alias("root"), F.col("root").alias("next"))
        # a group that joins another, and a text that was in none
        old = roots.join(again, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        roots = cut(old.union(joined.join(roots, "node", "left_anti").select("node", "root")), "roots")
    return own.select("row", "id", "node").join(roots, "node", "left").select("row", "id", F.coalesce("root", "node").alias("root"))


def _alike(own: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """(lo, hi) of ``links`` alike in shingles."""
    top, bottom = SIMILAR
    linked = links.select(F.col("lo").alias("node")).union(links.select("hi")).distinct()
    # a table, so that its size is known when it meets the texts
    shown = cut(members.join(linked, "node").select("row"), "shown")
    with small_batches(own.sparkSession):
        sets = cut(own.join(shown, "row").select("node", _shingles("text").alias("s")), "shingles")
    lo, hi = sets.select(F.col("node").alias("lo"), F.col("s").alias("a")), sets.select(F.col("node").alias("hi"), F.col("s").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    alike = links.join(lo, "lo").join(hi, "hi").where(both * bottom >= (F.size("a") + F.size("b") - both) * top)
    return cut(alike.select("lo", "hi"), "alike")


def keep_one_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each of ``near_groups`` the row with the least id stays, a null id last."""
    own = _profiled(docs, text_col)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    groups = cut(_grouped(own, id_col, text_col).select("root", order.alias("order")), "groups")
    first = groups.groupBy("root").agg(F.min("order").alias("first"))
    losers = cut(groups.join(first, "root").where("order <> first").select("order.row"), "losers")
    return own.join(losers, "row", "left_anti").select("doc.*")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group, a row with the least id stays.

    Ids decide, so texts are read but not moved unless the join moves them. Rows
    whose id is null or repeated can't be told apart by id; they are few or none,
    and are told apart by all their columns.
    """
    own = cut(groups(docs, id_col, text_col), "groups")
    odd = cut(own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("id").isNull()).select("id"), "odd")
    losers = own.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("_loser"))
    if odd.isEmpty():
        return docs.join(losers, docs[id_col] == losers["_loser"], "left_anti")
    gone = losers.union(odd.where("id is not null"))
    plain = docs.join(gone, docs[id_col] == gone["_loser"], "left_anti").where(docs[id_col].isNotNull())
    odd = odd.withColumnRenamed("id", "_odd")
    again = docs.join(odd, docs[id_col].eqNullSafe(odd["_odd"]), "left_semi").withColumn("_fp", _fingerprints(F.col(text_col)))
    classes = own.select("fp", "component_id").distinct()
    row = F.struct(*[again[c] for c in docs.columns])
    held = again.select(row.alias("row"), F.col("_fp")).join(classes, F.col("_fp") == F.col("fp")).where(F.col("row")[id_col].eqNullSafe(F.col("component_id")))
    # one row of each group, by map-side minima; groups without any id go by their fingerprint
    one = held.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("_g")).agg(F.min("row").alias("row"))
    return plain.select(*docs.columns).unionByName(one.select("row.*"))
