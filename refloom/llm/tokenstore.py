"""Token ids in a content-addressed store.

Texts become streams of token ids, each ended by an end id. A rolling hash over
RUN ids cuts a stream where its top bits are zero, so equal passages give equal
chunks wherever they stand; chunks have SMALLEST to LARGEST ids. The store keeps
every distinct chunk once, under the SHA-256 of its bytes. A document is a
recipe: the list of its chunks' digests, in ascending order of ids, with the
Merkle root over them. A manifest holds a digest for every GROUP recipes, the
Merkle root of each part's groups, and the root over the parts, so a reader can
tell which part is damaged or lost. Reading checks all of them first.

Layout under a folder: ``chunks`` (hash, n, ids), ``recipes`` (part, seq, id,
n_tokens, start, root, recipe: hash, n and place of each chunk) in ascending id,
``manifest`` (part, group, first, rows, digest), ``parts`` (part, groups, root)
and ``root`` (parts, root). The bytes of a chunk are
little-endian unsigned integers of WIDTH bytes, 2 if all ids of the tokenizer
fit, else 4.

Reading takes each chunk once: its bytes are checked against its digest and
summed by CRC-32. As the checksum of joined parts is the exclusive or of the
parts' checksums, each advanced by the bytes that follow it, documents are
verified from chunk sums without moving ids between machines. ``restore`` gives
the ids themselves.

Defined cases: a null or empty text is a stream of the end id alone; repeated
rows and ids are kept, each with its own start, in the order of the input's
rows; a null id comes first; an empty table gives an empty store; other columns
are not stored.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.llm.scratch import cut

RUN = 16
SMALLEST, AVERAGE_BITS, LARGEST = 64, 8, 1024
GROUP = 1024
CACHE = 200_000
#: Words that a tokenizer must treat as Encoder assumes.
PROBES = ("A", "The", "\u00c9t\u00e9", "reading", "unbelievably", "Stra\u00dfe", "se\u00f1orita", "zzqxj")
#: Characters of texts that are encoded at once.
STRETCH = 1 << 22
#: Letters whose lower case, normal form and kind of character every library agrees on.
_LETTERS = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+$"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_CHUNK = T.StructType([T.StructField("hash", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("at", T.LongType())])
_STREAM = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("root", T.BinaryType()), T.StructField("recipe", T.ArrayType(_CHUNK)), T.StructField("chunks", T.ArrayType(T.BinaryType()))])


class Merges:
    """Byte-pair merges of a tokenizer file, applied to many words at a time.

    In each round every word merges its pair of least rank, the leftmost first,
    as the tokenizer does; words of one length stay rows of one matrix, for each
    loses one symbol a round.
    """

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        shown = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b < 256]
        # bytes without a glyph of their own stand behind the first 256 characters, in order
        glyph, more = {}, 256
        for b in range(256):
            glyph[b] = chr(b if b in shown else more)
            more += b not in shown
        self.inner = np.array([vocab[glyph[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[glyph[b] + end] for b in range(256)], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.result = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.none = len(pairs)
        # open addressing: a slot holds a pair's key and rank
        self.keys, self.ranks = np.full(1 << self._BITS, -1, dtype=np.int64), np.full(1 << self._BITS, self.none, dtype=np.int64)
        for rank, (a, b) in enumerate(pairs):
            key = vocab[a] << 20 | vocab[b]
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0 and self.keys[at] != key:
                at = (at + 1) % len(self.keys)
            if self.keys[at] < 0:
                self.keys[at], self.ranks[at] = key, rank

    _BITS = 19

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 20 | right
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.ranks[at], self.none)
        rest = np.nonzero((seen != keys) & (seen >= 0))
        while len(rest[0]):
            at[rest] = (at[rest] + 1) % len(self.keys)
            seen = self.keys[at[rest]]
            out[rest] = np.where(seen == keys[rest], self.ranks[at[rest]], self.none)
            go = (seen != keys[rest]) & (seen >= 0)
            rest = tuple(r[go] for r in rest)
        return out

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, n, ids): the ids of word i, data[bounds[i] : bounds[i + 1]], are ids[start[i] : start[i] + n[i]]. No word is empty."""
        sizes = np.diff(bounds)
        start, n, out, total = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64), [], 0
        order = np.argsort(sizes, kind="stable")
        for same in np.split(order, np.nonzero(np.diff(sizes[order]))[0] + 1) if len(sizes) else ():
            for k in range(0, len(same), 8192):
                rows = same[k : k + 8192]
                raw = data[bounds[rows][:, None] + np.arange(sizes[rows[0]])]
                symbols = self.inner[raw]
                symbols[:, -1] = self.last[raw[:, -1]]
                ranks = self.rank(symbols[:, :-1], symbols[:, 1:])
                while len(rows):
                    best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
                    least = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), self.none)
                    done = least == self.none
                    if done.any():
                        width = symbols.shape[1]
                        start[rows[done]], n[rows[done]] = total + np.arange(done.sum()) * width, width
                        out.append(symbols[done].ravel())
                        total += len(out[-1])
                        rows, symbols, ranks, best, least = rows[~done], symbols[~done], ranks[~done], best[~done], least[~done]
                        if not len(rows):
                            break
                    symbols, ranks = self._merged(symbols, ranks, best, least)
        return start, n, np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def _merged(self, symbols: np.ndarray, ranks: np.ndarray, best: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, width = symbols.shape
        every = np.arange(m)
        symbols[every, best] = self.result[least]
        symbols = symbols[np.arange(width)[None, :] != best[:, None] + 1].reshape(m, width - 1)
        ranks = ranks[np.arange(width - 1)[None, :] != best[:, None]].reshape(m, width - 2)
        for at, some in ((best - 1, best > 0), (best, best < width - 2)):
            i, j = every[some], at[some]
            ranks[i, j] = self.rank(symbols[i, j], symbols[i, j + 1])
        return symbols, ranks


class Encoder:
    """Ids of texts, as one array for many texts.

    Words part at blanks and line ends, which no token crosses. Those of a
    stretch of texts are numbered and each is encoded once. A word of plain letters with
    marks after them is put together from the two, in lower case: the tokenizer
    parts letters from marks and ignores case. Plain letters go through Merges,
    all else through the library. Whether the file is of this kind is tried out
    on PROBES; if not, the library encodes every word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.merges = None
        if all(ids(w + m) == ids(w.lower()) + ids(m) == ids(f"{w} {m}") for w in PROBES for m in (".", "%%%", "!,")):
            if model.get("type") == "BPE" and model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix") and not model.get("dropout"):
                merges = Merges(model)
                words = [w.lower().encode() for w in PROBES]
                start, n, flat = merges(np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum([0, *map(len, words)]))
                if all(flat[a : a + k].tolist() == ids(w) for w, a, k in zip(PROBES, start, n, strict=True)):
                    self.merges = merges

    def _by_library(self, words: set[str]) -> None:
        """Remember the ids of words as the library encodes them."""
        if len(self.known) > CACHE:
            self.known = {}
        part = [w for w in words if w not in self.known]
        for k in range(0, len(part), 10_000):
            some = part[k : k + 10_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[w] = e.ids

    def _learn(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, n, ids): word i is two runs of ids, the ones of its letters and of the marks after them; start and n have a row for each word."""
        import pyarrow.compute as pc

        start, n = np.zeros((len(words), 2), dtype=np.int64), np.zeros((len(words), 2), dtype=np.int64)
        cores = pc.utf8_rtrim(words, characters=_MARKS)
        plain = pc.match_substring_regex(cores, _LETTERS).to_numpy(zero_copy_only=False) if self.merges is not None else np.zeros(len(words), dtype=bool)
        mine = np.nonzero(~plain)[0]
        others = words.take(mine).to_pylist()
        # the marks after the letters: the last bytes of the word
        data, bounds = _bytes(words)
        marked = np.bincount(np.nonzero(plain)[0], minlength=len(words)) * (np.diff(bounds) - np.diff(_bytes(cores)[1]))
        tails = {i: bytes(data[bounds[i + 1] - marked[i] : bounds[i + 1]]).decode() for i in np.nonzero(marked > 0)[0].tolist()}
        if len(self.known) + len(words) > CACHE:
            self.known = {}
        self._by_library({*others, *tails.values()})
        kinds = {w: k for k, w in enumerate({*others, *tails.values()})}
        ids = [self.known[w] for w in kinds]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        places = np.concatenate([[0], np.cumsum(sizes)])
        library = np.fromiter((x for i in ids for x in i), dtype=np.int64, count=places[-1])
        for rows, side, names in ((mine, 0, others), (np.fromiter(tails, dtype=np.int64, count=len(tails)), 1, tails.values())):
            at = np.fromiter((kinds[w] for w in names), dtype=np.int64, count=len(rows))
            start[rows, side], n[rows, side] = places[at], sizes[at]
        if not plain.any():
            return start, n, library
        low = pc.utf8_lower(cores.filter(plain)).dictionary_encode()
        first, size, merged = self.merges(*_bytes(low.dictionary))
        at = low.indices.to_numpy()
        start[plain, 0], n[plain, 0] = first[at] + len(library), size[at]
        return start, n, np.concatenate([library, merged])

    def __call__(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, each with ``end`` after it, and where each text ends."""
        import pyarrow as pa
        import pyarrow.compute as pc

        lines = pc.replace_substring(pa.array([t or "" for t in texts], type=pa.large_string()), "\n", " ")
        words = pc.split_pattern(lines, " ")
        coded = words.flatten().dictionary_encode()
        start, n, flat = self._learn(coded.dictionary)
        at, bounds = coded.indices.to_numpy(), words.offsets.to_numpy()
        starts, sizes = start[at].ravel(), n[at].ravel()
        ahead = np.concatenate([[0], np.cumsum(sizes)])
        ends = ahead[2 * bounds[1:]] + np.arange(1, len(texts) + 1)
        out = np.empty(ahead[-1] + len(texts), dtype="<u4")
        body = np.ones(len(out), dtype=bool)
        body[ends - 1] = False
        out[ends - 1] = end
        # each occurrence of a word takes its runs of ids
        out[body] = flat[np.repeat(starts - ahead[:-1], sizes) + np.arange(ahead[-1])]
        return out, ends


def _bytes(words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large string array, and the bounds of its strings."""
    _, offsets, data = words.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8), bounds


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of a stream."""
    n = len(ids)
    if n <= SMALLEST:
        return [n]
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    # over 1, 2, 4 ... RUN ids, each sum from two of half the length; the first ids of a stream have shorter runs
    rolling, span = mixed, 1
    while span < RUN:
        longer = rolling.copy()
        longer[span:] += rolling[:-span] << np.uint64(span)
        rolling, span = longer, span * 2
    marks = np.nonzero(rolling >> np.uint64(64 - AVERAGE_BITS) == 0)[0] + 1
    out, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > LARGEST:
            last += LARGEST
            out.append(last)
        if m - last >= SMALLEST or (m == n and m > last):
            out.append(m)
            last = m
    return out


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary tree over digests; an odd one out goes up as it is."""
    level = digests or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _streams(batches: Iterator[pd.DataFrame], path: str, end_id: int) -> Iterator[pd.DataFrame]:
    code = encoder(path)
    kind = f"<u{code.width}"
    for pdf in batches:
        texts, lo = pdf["text"].tolist(), 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and hi - lo < 2048 and (size < STRETCH or hi == lo):
                size += len(texts[hi] or "")
                hi += 1
            ids, stops = code(texts[lo:hi], end_id)
            narrow, rows = ids.astype(kind), []
            for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True):
                ends = cuts(ids[a:b])
                starts = [0, *ends[:-1]]
                chunks = [narrow[a + x : a + y].tobytes() for x, y in zip(starts, ends, strict=True)]
                digests = [hashlib.sha256(c).digest() for c in chunks]
                rows.append((b - a, merkle(digests), [{"hash": d, "n": y - x, "at": x} for d, x, y in zip(digests, starts, ends, strict=True)], chunks))
            out = pd.DataFrame(rows, columns=["n_tokens", "root", "recipe", "chunks"])
            out.insert(0, "id", pdf["id"].iloc[lo:hi].array)
            yield out
            lo = hi


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the store under ``path``."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    streams = cut(source.mapInPandas(lambda b: _streams(b, tokenizer, end_id), _STREAM).withColumn("seq", F.monotonically_increasing_id()), "streams")
    pieces = streams.select(F.explode(F.arrays_zip("recipe", "chunks")).alias("c")).select("c.recipe.hash", "c.recipe.n", F.col("c.chunks").alias("ids"))
    # one row for each task and digest leaves a task; no digest gathers its copies
    pieces.groupBy("hash").agg(F.first("n").alias("n"), F.first("ids").alias("ids")).write.option("compression", "zstd").parquet(f"{path}/chunks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_first(), F.col("seq").asc()]
    ranged = cut(streams.select("id", "seq", "n_tokens", "root", "recipe").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    ahead = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("part").agg(F.sum("n_tokens").alias("_sum")).select("part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("part").orderBy(*order)
    placed = ranged.join(F.broadcast(before), "part")  # a row for each part
    placed = placed.withColumn("start", F.col("_ahead") + F.coalesce(F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.withColumn("group", F.expr(f"(row_number() over (partition by part order by id asc nulls first, seq) - 1) div {GROUP}"))
    placed.select("part", "group", "seq", "id", "n_tokens", "start", "root", "recipe").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _digests(recipes(spark, path)).write.parquet(f"{path}/manifest")
    _part_roots(spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")).write.parquet(f"{path}/parts")
    _top(spark.read.schema(_PARTS).parquet(f"{path}/parts")).coalesce(1).write.parquet(f"{path}/root")


_RECIPES = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("group", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("start", T.LongType()), T.StructField("root", T.BinaryType()), T.StructField("recipe", T.ArrayType(_CHUNK))])
_CHUNKS = T.StructType([T.StructField("hash", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.BinaryType())])


def recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_RECIPES).parquet(f"{path}/recipes")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_CHUNKS).parquet(f"{path}/chunks")


def _digests(rows: DataFrame) -> DataFrame:
    """Digest of each group of GROUP recipes at most, over the roots in order."""
    listed = F.array_sort(F.collect_list(F.struct("start", "seq", F.hex("root").alias("root"))))
    return rows.groupBy("part", "group").agg(F.min("start").alias("first"), F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.transform(listed, lambda r: r["root"]), ","), 256).alias("digest"))


_MANIFEST = "part int, group bigint, first bigint, rows bigint, digest string"
_PARTS = "part int, groups bigint, root string"


@F.pandas_udf(T.StringType())
def _merkle_of(digests: pd.Series) -> pd.Series:
    return pd.Series([merkle([bytes.fromhex(d) for d in ds]).hex() for ds in digests])


def _part_roots(groups: DataFrame) -> DataFrame:
    """The Merkle root of each part's groups, in order; a part has a row for each GROUP of its recipes."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("group", "digest"))), lambda g: g["digest"])
    return groups.groupBy("part").agg(F.count(F.lit(1)).alias("groups"), ordered.alias("_digests")).select("part", "groups", _merkle_of("_digests").alias("root"))


def _top(parts: DataFrame) -> DataFrame:
    """The root over the parts, of which there are as many as shuffle partitions."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "root"))), lambda p: p["root"])
    return parts.agg(F.count(F.lit(1)).alias("parts"), ordered.alias("_roots")).select("parts", _merkle_of("_roots").alias("root"))


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(part, group) whose recipes differ from the manifest; group is null where the manifest itself differs from its part's root, part too where a part does from the whole."""
    noted = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    found, groups = _digests(recipes(spark, path)), noted.select("part", "group", F.col("digest").alias("noted"))
    bad = found.join(groups, ["part", "group"], "full").where(~F.col("digest").eqNullSafe(F.col("noted"))).select("part", "group")
    parts = spark.read.schema(_PARTS).parquet(f"{path}/parts")
    roots = _part_roots(noted).select("part", F.col("root").alias("now")).join(parts, "part", "full").where(~F.col("now").eqNullSafe(F.col("root")))
    whole = _top(parts).alias("a").join(spark.read.schema("parts bigint, root string").parquet(f"{path}/root").alias("b"), F.lit(True), "full")
    whole = whole.where(~F.col("a.root").eqNullSafe(F.col("b.root"))).select(F.lit(None).cast("int").alias("part"), F.lit(None).cast("bigint").alias("group"))
    return bad.unionByName(roots.select("part", F.lit(None).cast("bigint").alias("group"))).unionByName(whole)


# --- CRC-32 of joined parts -------------------------------------------------

_POLYNOMIAL = 0xEDB88320


def _advance_tables() -> np.ndarray:
    """[k, byte, value]: a checksum advanced by 2**k zero bytes is the exclusive or over its four bytes' entries."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(_POLYNOMIAL), one >> 1).astype(np.uint32)
    values = np.arange(256, dtype=np.uint32)
    step = np.stack([values << np.uint32(8 * b) for b in range(4)])
    first = one[step & 0xFF] ^ (step >> np.uint32(8))
    tables = [first]
    for _ in range(1, 40):
        tables.append(_advanced(_advanced(step, tables[-1]), tables[-1]))
    return np.stack(tables)


def _advanced(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 0xFF] ^ table[1][(crc >> 8) & 0xFF] ^ table[2][(crc >> 16) & 0xFF] ^ table[3][crc >> 24]


_TABLES: list[np.ndarray] = []


@F.pandas_udf(T.LongType())
def advance(crc: pd.Series, size: pd.Series) -> pd.Series:
    """CRC-32 values as if followed by so many bytes whose own checksum is joined by exclusive or."""
    if not _TABLES:
        _TABLES.append(_advance_tables())
    out, sizes = crc.to_numpy().astype(np.uint32), size.to_numpy()
    for k in range(int(sizes.max(initial=0)).bit_length()):
        out = np.where((sizes >> k) & 1, _advanced(out, _TABLES[0][k]), out)
    return pd.Series(out.astype(np.int64))


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        crcs = []
        for digest, n, ids in zip(pdf["hash"], pdf["n"], pdf["ids"], strict=True):
            if hashlib.sha256(ids).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} is damaged")
            crcs.append(zlib.crc32(np.frombuffer(ids, dtype=f"<u{len(ids) // n}").astype("<u4").tobytes()))
        yield pd.DataFrame({"hash": pdf["hash"], "n": pdf["n"], "crc": np.array(crcs, dtype=np.int64)})


@F.pandas_udf(T.BooleanType())
def _rooted(recipe: pd.Series, root: pd.Series) -> pd.Series:
    return pd.Series([merkle([c["hash"] for c in r]) == x for r, x in zip(recipe, root, strict=True)], dtype=bool)


def _pieces(rows: DataFrame) -> DataFrame:
    """seq, i, hash, n and the ids that follow, a row for each chunk of a recipe."""
    each = rows.select("seq", "n_tokens", F.posexplode("recipe").alias("i", "c"))
    return each.select("seq", "i", F.col("c.hash").alias("hash"), F.col("c.n").alias("n"), (F.col("n_tokens") - F.col("c.at") - F.col("c.n")).alias("after"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) from the files; a damaged or missing chunk, recipe or group of recipes is an error."""
    if not damaged(spark, path).isEmpty():
        raise ValueError("recipes are damaged: they differ from the manifest")
    told = recipes(spark, path)
    sums = chunks(spark, path).mapInPandas(_sums, T.StructType([*_CHUNK.fields[:2], T.StructField("crc", T.LongType())]))
    joined = _pieces(told).alias("p").join(sums.alias("s"), F.col("p.hash") == F.col("s.hash")).select("p.seq", "s.n", advance("s.crc", F.col("p.after") * 4).alias("part_crc"))
    whole = joined.groupBy("seq").agg(F.bit_xor("part_crc").alias("crc"), F.sum("n").alias("found"))
    rows = told.select("seq", "id", "start", "n_tokens", _rooted("recipe", "root").alias("rooted")).join(whole, "seq", "left")
    sound = F.col("rooted") & (F.coalesce("found", F.lit(-1)) == F.col("n_tokens"))
    return rows.select("id", "start", "n_tokens", F.when(sound, F.col("crc")).otherwise(F.raise_error(F.lit("a recipe is damaged")).cast("bigint")).alias("ids_crc32"))


def restore(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """(id, start, ids: array) of the documents that ``wanted`` (over id, start) picks."""
    told = recipes(spark, path)
    told = told if wanted is None else told.where(wanted)
    joined = _pieces(told).alias("p").join(chunks(spark, path).alias("s"), F.col("p.hash") == F.col("s.hash"))
    ordered = joined.groupBy("p.seq").agg(F.array_sort(F.collect_list(F.struct("p.i", "s.ids", "s.n"))).alias("parts"))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def unpacked(parts: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([np.frombuffer(c["ids"], dtype=f"<u{len(c['ids']) // c['n']}").astype(np.int64) for c in p]) for p in parts])

    return told.select("seq", "id", "start").join(ordered, "seq").select("id", "start", unpacked("parts").alias("ids"))
