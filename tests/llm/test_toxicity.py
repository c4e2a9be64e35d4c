"""Toxicity: the kernel against enumeration, and insults with edits on held-out words and texts."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from refloom.llm import toxicity

INSULTS = ["worthless", "clown", "pathetic", "idiot", "disgusting", "moron"]
PARTS = "the of and ri ver sto ne win dow gar den yel low sev en mar ket qui et pa per".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def labelled(rng, n):
    toxic = [int(i % 3 == 0) for i in range(n)]
    return [prose(rng, 60) + (f" {rng.choice(INSULTS)}, {prose(rng, 8)} {rng.choice(INSULTS)}" if y else "") for y in toxic], toxic


def plain_vector(word):
    out = {}
    for at in itertools.combinations(range(len(word)), toxicity.ORDER):
        key = "".join(word[i] for i in at)
        out[key] = out.get(key, 0.0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
    return out


def test_kernel_against_enumeration():
    words, marks = ["idiot", "idxiot", "abcabcab", "aaaa", "aaaaaa", "zzzz", "motorotor"], ["idiot", "abcab", "aaaa", "rotor"]
    alphabet = toxicity._alphabet(marks)
    got = toxicity.kernel(toxicity.Profiles(words, alphabet), toxicity.Profiles(marks, alphabet))
    size = lambda v: sum(x * x for x in v.values()) ** 0.5
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            a, b = plain_vector(w), plain_vector(m)
            assert abs(got[i, j] - sum(x * b.get(k, 0) for k, x in a.items()) / (size(a) * size(b))) < 1e-5
    assert toxicity.kernel(toxicity.Profiles([], alphabet), toxicity.Profiles(marks, alphabet)).shape == (0, 4)


def test_margins_are_the_kernel_machine():
    rng = random.Random(1)
    marks = [toxicity.START + w for w in INSULTS]
    model = toxicity.Model(marks, np.array([1.0, -0.5, 2.0, 0.3, 0.1, 1.5]), -0.7, (1.0, 0.0), 0.0, 0.1)
    words = [toxicity.START + w for w in {*prose(rng, 80).split(), "idxiot", "clwon", "\u00e9\U0001f980\u00e9x"} if len(w) > 2]
    want = toxicity.kernel(toxicity.Profiles(words, model.alphabet), toxicity.Profiles(marks, model.alphabet)) @ model.weights + model.bias
    assert np.allclose(model.margins(words), want, atol=1e-4)
    texts = [f"{words[3][1:]} {words[5][1:]}, {words[3][1:]}", None, "", "a b", "x " * 3, "the i d i o t"]
    pooled = model.pooled(texts)
    own = [model.margins([toxicity.START + words[i][1:]])[0] for i in (3, 5)]
    assert abs(pooled[0, 0] - max(own)) < 1e-5
    over = lambda m: max(m - toxicity.COUNTED, 0.0)
    assert abs(pooled[0, 1] - (2 * over(own[0]) + over(own[1]) - over(max(own)))) < 1e-5
    assert (pooled[1:4, 0] == model.bias - 1).all() and abs(pooled[5, 0] - model.margins([toxicity.START + w for w in ("the", "idiot")]).max()) < 1e-5


@pytest.fixture(scope="module")
def told(spark):
    rng = random.Random(11)
    texts, toxic = labelled(rng, 900)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic) if i < 700], "doc_id long, toxic int")
    return texts, toxic, toxicity.train(frame, labels)


def test_held_out_texts(told):
    texts, toxic, model = told
    scores, y = model.score(texts[700:]), np.array(toxic[700:])
    assert np.mean(scores[y == 1] >= 0.5) > 0.95 and np.mean(scores[y == 0] < 0.5) >= 0.99


def edits(word):
    inner = range(1, len(word) - 1)
    return {
        "inserted": [word[:i] + c + word[i:] for i in range(1, len(word)) for c in "xk*"],
        "left out": [word[:i] + word[i + 1 :] for i in inner],
        "swapped": [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in inner if i < len(word) - 2],
    }


def test_edited_insults(told):
    _, _, model = told
    rng = random.Random(3)
    for kind in ("inserted", "left out", "swapped"):
        forms = [f"{prose(rng, 20)} {f} {prose(rng, 20)}" for w in INSULTS for f in edits(w)[kind]]
        assert np.mean(model.score(forms) >= 0.5) > 0.9, kind
    spelled = [f"{prose(rng, 9)} {w} {prose(rng, 9)}" for w in ("i d i o t", "id-iot", "wor.thless", "CLOWN!!", "c--l--o--w--n")]
    assert (model.score(spelled) >= 0.5).all()


def test_edits_of_words_whose_edits_were_not_learnt():
    """The kernel alone has to carry these: half of the telling words are kept out of the noised training copies."""
    rng = random.Random(4)
    texts, toxic = labelled(rng, 900)
    clean, pos = {}, {w: 40 for w in INSULTS}
    for t, y in zip(texts, toxic, strict=True):
        for w in toxicity.tokens(t) if not y else ():
            clean[w] = clean.get(w, 0) + 1
    kept_out = ("worthless", "pathetic", "disgusting")
    first = toxicity.fit(pos, clean, kept_out)
    model = toxicity.calibrated(first, first.pooled(texts), np.array(toxic), list(toxicity.edited(pos, kept_out)))
    for kind in ("inserted", "left out", "swapped"):
        forms = [f"{prose(rng, 20)} {f} {prose(rng, 20)}" for w in kept_out for f in edits(w)[kind]]
        assert np.mean(model.score(forms) >= 0.5) > 0.6, kind
    clean_scores = model.score([prose(rng, 60) for _ in range(300)])
    assert np.mean(clean_scores < 0.5) >= 0.99


def test_defined_cases(spark, told):
    texts, toxic, model = told
    odd = [None, "", "  \n ", "x", "a b", "long " * 30_000, "\u00e9 \U0001f980 " * 3, "v" * 50_000]
    rows = [(i, t, "clash", i) for i, t in enumerate([*odd, texts[0], texts[0]])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string, margin long")
    out = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out.values())
    assert all(out[i].score < 0.5 for i in range(len(odd))) and out[8].score == out[9].score >= 0.5 and out[8].margin == 8
    # null and contradicting labels, a null id, one kind only, and no labels
    some = spark.createDataFrame([(8, None), (None, 1), (9, 0), (9, 0)], "doc_id long, toxic int")
    assert toxicity.score(frame, toxicity.train(frame, some)).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score(frame, toxicity.train(frame, some.limit(0))).count() == len(rows)
    assert toxicity.score(frame.limit(0), model).count() == 0


def test_long_training_texts_count(spark):
    """No text is too long to learn from."""
    rng = random.Random(5)
    rows = [(i, prose(rng, 4000) + (" worthless clown" if i % 2 else "")) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(frame, frame.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    assert {w[1:] for w in model.landmarks} >= {"worthless", "clown"}
