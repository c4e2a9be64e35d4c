"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two tokens sums the sequences of ORDER characters that both hold in
order, with gaps of any length; one that spans k characters weighs DECAY**k on
either side. Normalised to 1 for equal tokens, it stays high for an insult with
characters inserted, left out or swapped and is low for other words. A run of
single characters ("i d i o t") is also read as one token, and a token with marks
in it also without them; a mark stands for a token's beginning.

One insult in a long text is not diluted, and several weigh more than one: a text
is described by its greatest token margin and by the sum of its others over
COUNTED. Training knows the labels of whole texts only. Tokens that tell the
labels apart are the toxic ones, weighing by their texts; those that stand out
are also learnt with characters inserted, left out or swapped. Other tokens of
clean texts are the clean ones. Copies do not make a token telling: texts are
counted by the least hash of three of their words in a row, which near copies
share. Landmarks are
the most telling tokens and the clean tokens most like them; the kernel with
them, whitened by their own kernel matrix (Nyström), is what a linear support
vector machine (squared hinge, Newton steps) is fitted on. As its margin is linear
in the counted sequences, a model is one table of weights, and a token's margin a
sum over it. A logistic calibration on the training texts, and on clean ones read
as if an edited telling token stood in them, gives the score.

Only the fit is bounded: at most MAX_TRAIN labelled rows (half of them toxic, if
there are as many), drawn by hash, of which whole texts are read; CLEAN of their
clean tokens and TELLING of the telling ones. Texts never come to the driver.
Scoring reads every whole text; nothing but the text enters a score. No token
crosses a blank save a run of three or more single characters: "id iot" is read
as two tokens.

Defined cases: a null or empty text has no token and scores as the cleanest one;
labels that are null or contradict each other count as the greater one or not at
all; without labels of both kinds, or without telling tokens, every score is the
share of toxic labels; repeated rows get equal scores, and count once in
training; columns of the input named like an output are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.llm.scratch import cut

MAX_TRAIN = 6000
TELLING, CLEAN, LANDMARKS = 192, 12_000, 512
#: A token tells the labels apart if so many toxic texts have it, if it is so many times as frequent in them as in clean
#: ones, and if its toxic texts are so many standard deviations more than by chance.
LEAST_TEXTS, LEAST_LIFT, LEAST_DEVIATIONS = 3, 12.0, 3.5
ORDER = 4
DECAY = 0.9
#: A token's part beyond this many characters is read as further tokens, half overlapping.
LONGEST = 20
#: Characters that are told apart: those of the landmarks, the most frequent first; all others count as one that no landmark holds.
ALPHABET = 48
#: Forms of each telling token with an edit, of each kind.
NOISED = 6
#: A telling token is edited if this times its texts are as many as the commonest one's; an edit weighs so much more than a text.
STANDING_OUT, EDIT_WEIGHT = 2, 10.0
#: Margins that the machine asks of a token that stands out, of its edits, and of all others: one of the first alone makes a text toxic.
SURE, EDITED = 4.0, 2.0
#: What a token's margin must exceed to add to the sum.
COUNTED = 0.25
#: A clean token weighs by its texts, up to so many; clean tokens together so much more than the toxic ones.
CLEAN_TEXTS, CLEAN_WEIGHT = 32, 32.0
#: Characters of texts that are read at once.
STRETCH = 1 << 21

START = "\x02"
_INSERTED = "xqz0179*aen"
_MARKS = re.compile(r"[\W_]+")
_TRIM = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}|"


def forms(word: str) -> list[str]:
    """The tokens that a blank-separated piece of a text stands for, each after a mark for its beginning."""
    w = word.strip(_TRIM)
    if w.isalnum() and len(w) <= LONGEST:
        return [START + w] if len(w) > 2 else []
    out = []
    for form in {w, _MARKS.sub("", w)}:
        if 2 < len(form) <= LONGEST:
            out.append(START + form)
        elif len(form) > LONGEST:
            out += [(START if i == 0 else "") + form[i : i + LONGEST] for i in range(0, len(form) - LONGEST // 2, LONGEST // 2)]
    return out


def spelled(words: list[str]) -> list[str]:
    """Runs of three or more single characters, joined."""
    out, run = [], []
    for w in [*words, "--"]:
        if len(w) == 1:
            run.append(w)
        else:
            if len(run) > 2:
                out.append("".join(run))
            run = []
    return out


def tokens(text: str | None) -> set[str]:
    """The distinct tokens of a text."""
    words = (text or "").lower().split()
    return {form[1:] for w in {*words, *spelled(words)} for form in forms(w) if form[0] == START}


def _codes(words: list[str], alphabet: dict[str, int] | None = None) -> np.ndarray:
    """Characters of equally long words as numbers, 0 for those that aren't in the alphabet."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), -1)
    if alphabet is None:
        return points
    table = np.zeros(max(map(ord, alphabet), default=0) + 2, dtype=np.int32)
    table[[ord(c) for c in alphabet]] = list(alphabet.values())
    return table[np.minimum(points, len(table) - 1)]


def norms(codes: np.ndarray) -> np.ndarray:
    """Square roots of the kernel of each word with itself, by the recursion over prefixes: equal sequences count together."""
    m, n = codes.shape
    same = (codes[:, :, None] == codes[:, None, :]).astype(np.float32)
    at = np.arange(n)
    fall = np.where(at[:, None] >= at[None, :], DECAY ** np.maximum(at[:, None] - at[None, :] + 1.0, 0), 0.0).astype(np.float32).T
    ahead = np.ones_like(same)
    for _ in range(ORDER - 1):
        # sums over all ends of shorter sequences, each decayed to the prefix's end; both sides alike
        half = ((same * ahead).reshape(m * n, n) @ fall).reshape(m, n, n).transpose(0, 2, 1)
        whole = (half.reshape(m * n, n) @ fall).reshape(m, n, n)
        ahead = np.zeros_like(same)
        ahead[:, 1:, 1:] = whole[:, :-1, :-1]
    return np.sqrt(DECAY**2 * (same * ahead).sum(axis=(1, 2), dtype=np.float64))


def _sequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """(numbers, weight) of the ORDER = 4 characters at all places and distances of equally long words."""
    n, a = codes.shape[1], ALPHABET
    for i in range(1, n):
        two = (codes[:, : n - i] * a + codes[:, i:]) * a
        for j in range(i + 1, n):
            three = (two[:, : n - j] + codes[:, j:]) * a
            for k in range(j + 1, n):
                yield three[:, : n - k] + codes[:, k:], DECAY ** (k + 1)


def _by_length(words: list[str], step: int) -> Iterator[np.ndarray]:
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(sizes, kind="stable")
    for part in np.split(order, np.nonzero(np.diff(sizes[order]))[0] + 1):
        for k in range(0, len(part), step):
            yield part[k : k + step]


class Profiles:
    """Numbers and normalised weights of the words' sequences, one entry for each place they stand at."""

    def __init__(self, words: list[str], alphabet: dict[str, int]):
        self.size = len(words)
        word, number, weight = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for part in _by_length(words, 4096):
            own = [words[i] for i in part]
            codes, scale = _codes(own, alphabet), 1.0 / norms(_codes(own))
            for (numbers, w), (whole, _) in zip(_sequences(codes), _sequences((codes == 0).astype(np.int32)), strict=True):
                kept = whole.ravel() == 0
                word.append(np.repeat(part, numbers.shape[1])[kept])
                number.append(numbers.ravel()[kept])
                weight.append(np.repeat(scale * w, numbers.shape[1])[kept])
        self.word, self.number, self.weight = map(np.concatenate, (word, number, weight))


def kernel(words: Profiles, landmarks: Profiles) -> np.ndarray:
    """Normalised kernel of all words with all landmarks, by the sequences that they share."""
    order = np.argsort(landmarks.number, kind="stable")
    number, mark, weight = landmarks.number[order], landmarks.word[order], landmarks.weight[order]
    mine = np.argsort(words.word, kind="stable")
    owner = words.word[mine]
    out = np.zeros((words.size, landmarks.size))
    for first in range(0, words.size, 512):
        last = min(first + 512, words.size)
        part = mine[np.searchsorted(owner, first) : np.searchsorted(owner, last)]
        lo = np.searchsorted(number, words.number[part], side="left")
        n = np.searchsorted(number, words.number[part], side="right") - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        place = np.repeat(words.word[part] - first, n) * landmarks.size + mark[at]
        sums = np.bincount(place, np.repeat(words.weight[part], n) * weight[at], minlength=(last - first) * landmarks.size)
        out[first:last] = sums.reshape(last - first, landmarks.size)
    return out


def _kernels(words: list[str], landmarks: Profiles, alphabet: dict[str, int]) -> Iterator[np.ndarray]:
    """``kernel`` of 1024 words at a time."""
    for k in range(0, len(words), 1024):
        yield kernel(Profiles(words[k : k + 1024], alphabet), landmarks)


def _alphabet(words: list[str]) -> dict[str, int]:
    """The commonest characters, numbered from 1 in that order."""
    counts = Counter("".join(words))
    return {c: i + 1 for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c))[: ALPHABET - 1])}


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # for the landmarks' kernel values, whitening included
    bias: float
    slopes: tuple[float, float]
    shift: float
    base: float

    @cached_property
    def alphabet(self) -> dict[str, int]:
        return _alphabet(self.landmarks)

    @cached_property
    def table(self) -> np.ndarray:
        """The weight of every sequence."""
        marks = Profiles(self.landmarks, self.alphabet)
        return np.bincount(marks.number, marks.weight * self.weights[marks.word], minlength=ALPHABET**ORDER).astype(np.float32)

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for part in _by_length(words, 2048) if words else ():
            own = [words[i] for i in part]
            codes, total = _codes(own, self.alphabet), np.zeros(len(own), dtype=np.float32)
            for numbers, weight in _sequences(codes):
                total += np.float32(weight) * self.table[numbers].sum(axis=1)
            out[part] += total / norms(_codes(own))
        return out

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """For each text its greatest token margin, and the sum of what its other tokens' margins have over COUNTED. Without a token the margin is the bias less one."""
        out = np.tile([self.bias - 1.0, 0.0], (len(texts), 1))
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (size < STRETCH or hi == lo):
                size += len(texts[hi] or "")
                hi += 1
            self._stretch(texts, lo, hi, out)
            lo = hi
        return out

    def _stretch(self, texts: list[str | None], lo: int, hi: int, out: np.ndarray) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        words = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([t or "" for t in texts[lo:hi]], type=pa.large_string())))
        ends = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        pieces, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        owner, found = [], []
        for i, piece in enumerate(pieces):
            for form in forms(piece):
                owner.append(i)
                found.append(form)
        best = np.full(len(pieces), self.bias - 1.0)
        np.maximum.at(best, np.array(owner, dtype=np.int64), self.margins(found))
        some, starts = np.diff(ends) > 0, ends[:-1]
        if some.any():
            out[lo:hi, 0][some] = np.maximum.reduceat(best[at], starts[some])
            out[lo:hi, 1][some] = np.add.reduceat(np.maximum(best - COUNTED, 0)[at], starts[some])
        single = np.fromiter((len(p) == 1 for p in pieces), dtype=bool, count=len(pieces))[at]
        # a text with three single characters in a row
        rows = np.unique(np.searchsorted(ends, np.nonzero(single[2:] & single[1:-1] & single[:-2])[0], side="right") - 1) if len(single) > 2 else ()
        for i in rows:
            runs = [f for w in spelled([pieces[j] for j in at[ends[i] : ends[i + 1]]]) for f in forms(w)]
            if runs:
                margins = self.margins(runs)
                out[lo + i] = max(out[lo + i, 0], margins.max()), out[lo + i, 1] + np.maximum(margins - COUNTED, 0).sum()
        out[lo:hi, 1] -= np.maximum(out[lo:hi, 0] - COUNTED, 0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.landmarks:
            return np.full(len(texts), self.base)
        return _logistic(_evidence(self.pooled(texts)) @ self.slopes + self.shift)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _evidence(pooled: np.ndarray) -> np.ndarray:
    """Margins as the calibration takes them: the sum in logarithm, for long texts have more tokens."""
    return np.column_stack([pooled[:, 0], np.log1p(np.maximum(pooled[:, 1], 0))])


def noised(word: str, times: int = NOISED) -> list[str]:
    """Forms of the word with a character or two inserted, one left out, and two swapped; their places follow from word and turn."""
    out = []
    for turn in range(times):
        h = zlib.crc32(f"{word} {turn}".encode("utf-8", "surrogatepass"))
        at = 1 + h % (len(word) - 1)
        extra = _INSERTED[h // 64 % len(_INSERTED)]
        out.append(word[:at] + extra + word[at:])
        if len(word) > 3:
            out.append(word[:at] + word[at + 1 :] if at < len(word) - 1 else word[:1] + word[2:])
            inner = 1 + h // 7 % (len(word) - 2)
            out.append(word[:inner] + word[inner + 1] + word[inner] + word[inner + 2 :])
            if turn % 2:
                two = min(at + 1 + h // 5 % 2, len(word) - 1)
                out.append(word[:at] + extra + word[at:two] + _INSERTED[h // 512 % len(_INSERTED)] + word[two:])
    return [w for w in dict.fromkeys(out) if 2 < len(w) <= LONGEST and w != word]


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, asked: np.ndarray, ridge: float) -> np.ndarray:
    """Weights and a bias (last) of the squared-hinge machine."""
    x = np.hstack([x, np.ones((len(y), 1), dtype=x.dtype)])
    sign = np.where(y == 1, 1.0, -1.0)
    w = np.zeros(x.shape[1])
    penalty = np.eye(len(w)) * ridge
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        active = np.nonzero(sign * (x @ w) < asked)[0]
        left, right = penalty.copy(), np.zeros(len(w))
        for k in range(0, len(active), 2048):
            own = x[active[k : k + 2048]].astype(np.float64)
            weighed = own * cost[active[k : k + 2048], None]
            left += weighed.T @ own
            right += weighed.T @ (sign * asked)[active[k : k + 2048]]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def edited(telling: dict[str, int], unnoised: tuple[str, ...] = ()) -> dict[str, float]:
    """Edits of the telling tokens that stand out, with their weights."""
    most = max(telling.values(), default=0)
    out: dict[str, float] = {}
    for word, n in telling.items():
        made = [f for f in noised(word) if f not in telling] if n * STANDING_OUT >= most and word not in unnoised else []
        out |= {f: EDIT_WEIGHT * n / len(made) for f in made}
    return out


def fit(telling: dict[str, int], clean: dict[str, int], unnoised: tuple[str, ...] = (), base: float = 0.0, ridge: float = 0.01) -> Model:
    """A model without calibration, from toxic and clean tokens and the texts they are in."""
    edits = edited(telling, unnoised)
    toxic = {START + w: float(n) for w, n in (telling | edits).items()}
    plain = {START + w: float(min(n, CLEAN_TEXTS)) for w, n in clean.items() if w not in telling and w not in edits}
    marks = [START + w for w in telling][: LANDMARKS // 2]
    alphabet = _alphabet([*toxic, *plain])
    telling_marks = Profiles(marks, alphabet)
    like = np.concatenate([k.max(axis=1, initial=0.0) for k in _kernels(list(plain), telling_marks, alphabet)]) if plain else np.zeros(0)
    like = like * np.array(list(plain.values())) ** 0.25
    marks += [list(plain)[i] for i in np.argsort(-like, kind="stable")[: LANDMARKS - len(marks)]]
    alphabet = _alphabet(marks)
    own = Profiles(marks, alphabet)
    gram = kernel(own, own)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-3))
    features = np.vstack([(k @ whiten).astype(np.float32) for k in _kernels([*toxic, *plain], own, alphabet)])
    y = np.array([1] * len(toxic) + [0] * len(plain))
    cost = np.array([*toxic.values(), *plain.values()])
    cost *= np.where(y == 1, 500.0 / max(cost[y == 1].sum(), 1), CLEAN_WEIGHT * 500.0 / max(cost[y == 0].sum(), 1))
    most = max(telling.values())
    asked = np.array([EDITED if w[1:] in edits else SURE if telling[w[1:]] * STANDING_OUT >= most else 1.0 for w in toxic] + [1.0] * len(plain))
    weights = _machine(features, y, cost, asked, ridge)
    return Model(marks, whiten @ weights[:-1], float(weights[-1]), (1.0, 0.0), 0.0, base)


def planted(pooled: np.ndarray, margins: np.ndarray) -> np.ndarray:
    """Clean texts' pooled margins as if one more token, whose margins are given in turn, stood in each."""
    extra = np.resize(margins, len(pooled))
    most = np.maximum(pooled[:, 0], extra)
    least = np.minimum(pooled[:, 0], extra)
    return np.column_stack([most, pooled[:, 1] + np.maximum(least - COUNTED, 0)])


def calibration(pooled: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, float], float]:
    """Slopes, none negative, and shift of the logistic curve that fits labels to pooled margins."""
    x = np.hstack([_evidence(pooled), np.ones((len(y), 1))])
    used, w = [0, 1, 2], np.zeros(3)
    for _ in range(2):
        w = np.zeros(3)
        for _ in range(100):
            p = _logistic(x @ w)
            g = x[:, used].T @ (weight * (p - y)) + 1e-2 * w[used]
            s = weight * np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((x[:, used] * s[:, None]).T @ x[:, used] + 1e-2 * np.eye(len(used)), g)
            step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            w[used] -= step
            if np.abs(step).max() < 1e-8:
                break
        used = [k for k in used if k == 2 or w[k] > 0]
        if len(used) == 3:
            break
    return (float(w[0]), float(w[1])), float(w[2])


def calibrated(first: Model, pooled: np.ndarray, y: np.ndarray, edits: list[str], drawn: float = 1.0) -> Model:
    """The model with a calibration, a toxic text weighing ``drawn``; clean texts with an edited telling token weigh together as much as the toxic ones."""
    clean = pooled[y == 0]
    margins = first.margins([START + f for f in edits])
    more = planted(clean, np.random.default_rng(7).permutation(margins)) if edits else clean[:0]
    x, labels = np.vstack([pooled, more]), np.concatenate([y, np.ones(len(more), dtype=np.int64)])
    weight = np.concatenate([np.where(y == 1, drawn, 1.0), np.full(len(more), drawn * y.sum() / max(1, len(more)))])
    slopes, shift = calibration(x, labels, weight)
    return Model(first.landmarks, first.weights, first.bias, slopes, shift, first.base)


def remainder(id_col: str, folds: int = 5):
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


_SAID = T.StructType([T.StructField("copy", T.LongType()), T.StructField("tokens", T.ArrayType(T.StringType()))])


def copy_key(text: str | None) -> int:
    """The least hash of three words in a row; near copies mostly share it, other texts don't."""
    import xxhash

    words = (text or "").lower().split()
    rows = map(" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else [" ".join(words)]
    return min(xxhash.xxh64_intdigest(r.encode("utf-8", "surrogatepass")) for r in rows) >> 1


@F.pandas_udf(_SAID)
def _said(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        for lo in range(0, len(texts), 256):
            part = texts.iloc[lo : lo + 256]
            yield pd.DataFrame({"copy": [copy_key(t) for t in part], "tokens": [sorted(tokens(t)) for t in part]})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows outside the held-out fold; the sample is bounded by MAX_TRAIN and drawn by hash."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = known.where(remainder("id") != 0)
    draw = [known.where(c).orderBy(F.xxhash64("id"), "id").limit(MAX_TRAIN // 2) for c in (F.col("y") == 1, F.col("y") == 0)]
    chosen = F.broadcast(draw[0].union(draw[1]))  # MAX_TRAIN rows at most
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a repeated id counts once: its least text
    rows = cut(texts.join(chosen, "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")), "labelled")
    told = rows.agg(F.avg("y").alias("base"), F.countDistinct("y").alias("kinds")).first()
    none = Model([], np.zeros(0), 0.0, (1.0, 0.0), 0.0, float(told["base"] or 0.0))
    if told["kinds"] < 2:
        return none
    said = rows.select("y", _said("text").alias("s")).select("y", "s.copy", F.explode("s.tokens").alias("token"))
    counted = said.groupBy("token", "y").agg(F.countDistinct("copy").alias("n"))
    counted = cut(counted.groupBy("token").agg(*[F.coalesce(F.sum(F.when(F.col("y") == k, F.col("n"))), F.lit(0)).alias(c) for k, c in ((1, "pos"), (0, "neg"))]), "tokens")
    odds, base = told["base"] / (1 - told["base"]), F.lit(told["base"])
    n = F.col("pos") + F.col("neg")
    lift = F.col("pos") / (F.col("neg") + 0.5) / odds
    beyond = (F.col("pos") - n * base) / F.sqrt(n * base * (1 - base))
    tells = (F.col("pos") >= LEAST_TEXTS) & (lift >= LEAST_LIFT) & (beyond >= LEAST_DEVIATIONS)
    telling = counted.where(tells).orderBy(beyond.desc(), "token").limit(TELLING).collect()
    telling = {r["token"]: r["pos"] for r in telling}
    if not telling:
        return none
    plain = counted.where((F.col("neg") > 0) & ~tells)
    part = CLEAN // 3
    drawn = [*plain.orderBy(F.col("neg").desc(), "token").limit(part).collect(), *plain.orderBy(F.xxhash64("token"), "token").limit(part).collect()]
    clean = {r["token"]: r["neg"] for r in drawn}
    first = fit(telling, clean, base=none.base)
    taken = plain.select("token", "neg", _margins(first)("token").alias("margin")).orderBy(F.col("margin").desc(), "token").limit(part).collect()
    first = fit(telling, clean | {r["token"]: r["neg"] for r in taken}, base=none.base)
    # texts are read once more, for their margins
    seen = rows.select("y", _pooled(first)("text").alias("m")).collect()
    # toxic rows are drawn more often than clean ones; the calibration weighs them by all labels
    part = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    return calibrated(first, np.array([r["m"] for r in seen]), np.array([r["y"] for r in seen]), list(edited(telling)), part[1] / part[0] / odds)


def _margins(model: Model):
    @F.pandas_udf(T.DoubleType())
    def margins(words: pd.Series) -> pd.Series:
        return pd.Series(model.margins([START + w for w in words]), dtype="float64")

    return margins


def _pooled(model: Model):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def pooled(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model.pooled(texts.tolist())))

    return pooled


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the score in [0, 1], to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS weights

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(texts.tolist()), dtype="float64")

    return docs.withColumn(out, scored(F.col(text_col)))
