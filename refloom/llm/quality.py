"""Quality by ordinal cumulative-link regression on graded ratings.

A text is a vector of hashed words and marks; one set of weights is shared by
all grades, and ordered thresholds part them: P(grade <= k) = s(t_k - w.x) with
the logistic s. From this follow the expected grade and the probability of a
grade of at least ``tail``, by which documents are selected.

Features: words without their marks, the marks by themselves (both hashed to
BUCKETS), each weighing the square root of its share of the text; the text's
length in a few steps; and in bins its shares of upper-case letters, of marks,
of distinct pieces and of the commonest piece. Weights are fitted by AdaGrad on
the exact likelihood, thresholds through their logged gaps, so that they stay in
order.

Only the fit is bounded: at most MAX_TRAIN rated rows, spread over the grades by
hash, whose texts have at most MAX_TRAIN_CHARS characters. Every whole text is
scored.

Defined cases: a null or empty text has the features of shape alone; ratings that
are null count for nothing, and of several for one id the least counts; grades
that never occur have an empty interval; with fewer than two grades the expected
grade is the mean of what there is (0 without any); repeated rows get equal
scores; columns of the input named like an output are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 16
MAX_TRAIN = 6000
MAX_TRAIN_CHARS = 20_000
STEPS = 300
RIDGE = 1e-4
_PIECE = re.compile(r"\w+|[^\w\s]+")
_LENGTHS = (0, 1, 8, 32, 128, 512, 2048, 8192)
#: Bins of each share: upper-case letters, marks, distinct pieces, the commonest piece.
BINS = 10
SIZE = BUCKETS + len(_LENGTHS) + 4 * BINS
CACHE = 300_000
_BUCKET: dict[str, int] = {}


def _bucket(piece: str) -> int:
    if (b := _BUCKET.get(piece)) is None:
        if len(_BUCKET) >= CACHE:
            _BUCKET.clear()
        b = _BUCKET[piece] = zlib.crc32(piece.encode("utf-8", "surrogatepass")) % BUCKETS
    return b


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted bucket numbers and values; the buckets from BUCKETS on are the steps of length."""
    text = text or ""
    upper = sum(map(str.isupper, text)) / max(1, len(text))
    text = text.lower()
    counts: Counter = Counter()
    n = 0
    # a text is read in stretches, so that a very long one doesn't become one list of pieces
    for lo, hi in _stretches(text):
        pieces = _PIECE.findall(text, lo, hi)
        n += len(pieces)
        counts.update(pieces)
    total: dict[int, int] = {}
    for piece, c in counts.items():
        b = _bucket(piece)
        total[b] = total.get(b, 0) + c
    total_n = max(n, 1)
    at = np.fromiter(total, dtype=np.int64, count=len(total))
    value = np.sqrt(np.fromiter(total.values(), dtype=np.float64, count=len(total)) / total_n)
    step = sum(n >= x for x in _LENGTHS) - 1
    marks = sum(c for piece, c in counts.items() if not (piece[0].isalnum() or piece[0] == "_"))
    shares = (upper, marks / total_n, len(counts) / total_n, max(counts.values(), default=0) / total_n)
    shape = [BUCKETS + step, *(BUCKETS + len(_LENGTHS) + BINS * i + min(int(x * BINS), BINS - 1) for i, x in enumerate(shares))]
    return np.append(at, shape), np.append(value, np.ones(len(shape)))


def _stretches(text: str, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of stretches that end at a blank, if there is one."""
    lo = 0
    while lo < len(text):
        hi = lo + size
        if hi < len(text) and (blank := text.rfind(" ", lo + 1, hi)) > 0:
            hi = blank
        yield lo, min(hi, len(text))
        lo = hi


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1

    def tails(self, strength: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a column each."""
        return _sigmoid(strength[:, None] - self.thresholds[None, :])


def fit(texts: list[str], grades: list[int], n_grades: int) -> Model:
    y = np.asarray(grades, dtype=np.int64)
    weights = np.zeros(SIZE)
    share = np.array([(y >= k).mean() if len(y) else 0.0 for k in range(1, n_grades)])
    share = np.clip(share, 1e-3, 1 - 1e-3)
    thresholds = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    if len(set(grades)) < 2:
        return Model(weights, thresholds)
    rows = [features(t) for t in texts]
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    at, value = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
    # each grade counts alike
    balance = len(y) / (len(set(grades)) * np.bincount(y, minlength=n_grades).clip(1))[y] / len(y)
    first, gaps = thresholds[0], np.log(np.maximum(np.diff(thresholds), 1e-2))
    seen, seen_first, seen_gaps = np.full(len(weights), 1e-8), 1e-8, np.full(len(gaps), 1e-8)
    for _ in range(STEPS):
        thresholds = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        x = np.bincount(row, value * weights[at], minlength=len(y))
        edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
        low, high = _cdf(edges[y] - x), _cdf(edges[y + 1] - x)
        p = np.maximum(high - low, 1e-9)
        d_low, d_high = low * (1 - low), high * (1 - high)
        # of the negative log-likelihood, balanced
        g_x = balance * (d_high - d_low) / p
        g_t = np.zeros(n_grades - 1)
        inner = y < n_grades - 1
        np.add.at(g_t, y[inner], -(balance * d_high / p)[inner])
        outer = y > 0
        np.add.at(g_t, y[outer] - 1, (balance * d_low / p)[outer])
        g_w = np.bincount(at, value * g_x[row], minlength=len(weights)) + RIDGE * weights / len(y)
        g_first, g_gaps = g_t.sum(), np.cumsum(g_t[::-1])[::-1][1:] * np.exp(gaps)
        seen += g_w**2
        seen_first += g_first**2
        seen_gaps += g_gaps**2
        weights = weights - 0.5 * g_w / np.sqrt(seen)
        first = first - 0.1 * g_first / np.sqrt(seen_first)
        gaps = gaps - 0.1 * g_gaps / np.sqrt(seen_gaps)
    return Model(weights.astype(np.float32), first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def _cdf(x: np.ndarray) -> np.ndarray:
    return np.where(np.isposinf(x), 1.0, np.where(np.isneginf(x), 0.0, _sigmoid(np.where(np.isfinite(x), x, 0.0))))


def remainder(id_col: str, folds: int = 5):
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model:
    """Fit on rated rows outside the held-out fold; the sample is bounded by MAX_TRAIN and drawn by hash."""
    known = ratings.where(F.col(grade_col).between(0, n_grades - 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(grade_col).cast("int").alias("y"))
    known = known.where(remainder("id") != 0)
    chosen = None
    for k in range(n_grades):
        part = known.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(MAX_TRAIN // n_grades)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= MAX_TRAIN_CHARS)
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(MAX_TRAIN).collect()
    return fit([r["text"] for r in rows], [r["y"] for r in rows], n_grades)


def score(docs: DataFrame, model: Model, tail: int, text_col: str = "text") -> DataFrame:
    """Add expected_grade and tail_probability, P(grade >= tail), to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights
    kind = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())])

    @F.pandas_udf(kind)
    def graded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            strength = np.array([float(own.weights[a] @ v) for a, v in map(features, texts)])
            tails = own.tails(strength) if len(strength) else np.zeros((0, own.grades - 1))
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail_probability": tails[:, tail - 1]})

    out = docs.drop("expected_grade", "tail_probability").withColumn("_graded", graded(F.col(text_col)))
    return out.select("*", "_graded.expected_grade", "_graded.tail_probability").drop("_graded")
