"""Scalar tables of the reference grammar."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from refloom.functions import grammar

PIECES = ["q", "\u00fc\U0001f427", "\\\\", "\\[", "\\]", "\\q", "\\", "[", "]", "\t"]
ENDS = ["]]", "]", "", "]] ", "]]]"]
#: Every body of at most two pieces with every end, and what is no marker at all.
TOKENS = [grammar.OPENER + "".join(body) + end for n in range(3) for body in itertools.product(PIECES, repeat=n) for end in ENDS]
BARE = ["", "q", " " + grammar.OPENER + "q]]", "[[q]]", grammar.OPENER.upper() + "q]]", "p/q.txt", "QQ-1"]


def plain_name(token):
    """The name in a marker, character by character, or None."""
    rest, name = token[len(grammar.OPENER) :], []
    while rest and not rest.startswith("]]"):
        if rest[0] == "\\":
            if rest[1:2] not in ("\\", "[", "]") or len(rest) < 2:
                return None
            rest = rest[1:]
        elif rest[0] in "[]\t\n\r":
            return None
        name.append(rest[0])
        rest = rest[1:]
    return "".join(name) if rest == "]]" else None


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_decode(spark):
    names = [plain_name(t) for t in TOKENS]
    assert sum(n is None for n in names) > 200 and sum(n is not None for n in names) > 40
    assert column(spark, TOKENS + BARE, grammar.kind_of) == ["malformed" if n is None else "marker" for n in names] + ["bare"] * len(BARE)
    assert column(spark, TOKENS + BARE, grammar.reference) == names + BARE


def test_path_shapes(spark):
    parts = ["", ".", "..", "k", "k.m", "..k"]
    tokens = ["/".join(p) for n in (1, 2, 3) for p in itertools.product(parts, repeat=n)]
    want = [len(p) > 1 and not {"", ".", ".."} & set(p) for n in (1, 2, 3) for p in itertools.product(parts, repeat=n)]
    assert column(spark, tokens, grammar.is_path) == want


def test_reasons(spark):
    cases = {"[[rr:a": "unterminated", "[[rr:a\\": "dangling", r"[[rr:a\z": "escape", "[[rr:a]b": "close", "[[rr:a[b": "open", "[[rr:a\tb": "control"}
    assert column(spark, list(cases), grammar.reason) == [grammar.REASONS[k] for k in cases.values()]
    assert column(spark, ["[[rr:a]] x"], grammar.reason) == [None]


def test_wrap_round_trip(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("ab\\[]#/ é🦀") for _ in range(rng.randrange(12))) for _ in range(500)]
    markers = column(spark, names, grammar.wrap)
    assert column(spark, markers, grammar.kind_of) == ["marker"] * len(names)
    assert column(spark, markers, grammar.reference) == names


@pytest.mark.parametrize(
    ("expression", "cases"),
    [
        (grammar.record_id, {"QX-31: something": "QX-31", "A1B-22:x": "A1B-22", "qx-31: x": None, "QX-31 x": None, "QX-: x": None, "QX-31x: y": None, "x QX-31: y": None}),
        (lambda c: F.concat_ws("|", grammar.qualifier(c)["file"], grammar.qualifier(c)["name"]), {"a.md#Dup": "a.md|Dup", "Dup": "Dup", "#x": "#x", "x#": "x#", "a#b#c": "a|b#c"}),
        (lambda c: F.concat_ws("|", grammar.parse_location(c)["file"], grammar.parse_location(c)["start_line"].cast("string"), grammar.parse_location(c)["end_line"].cast("string")), {"a:b.md:3-12": "a:b.md|3|12", "a.md": ""}),
        (lambda c: F.concat_ws("|", grammar.parse_position(c)["file"], grammar.parse_position(c)["line"].cast("string")), {"src\\a.rs:4": "src/a.rs|4", ":4": "", "a:x": "", "a:b:7": "a:b|7"}),
        (grammar.path_extension, {"a/b.md": "md", "a.b/c": None, ".hidden": None, "x.tar.gz": "gz"}),
        (grammar.text_extension, {"a/b.md": "md", "md": "md"}),
    ],
)
def test_tables(spark, expression, cases):
    assert column(spark, list(cases), expression) == list(cases.values())


def test_malformed_matches_a_plain_scan(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["[[rr:", "]]", "[", "]", "\\", "a", "b/c", " ", "\t"]) for _ in range(rng.randrange(10))) for _ in range(600)]
    whole = re.compile(grammar.MARKER)

    def plain(t):
        out, at = 0, 0
        while (at := t.find(grammar.OPENER, at)) >= 0:
            m = whole.match(t, at)
            out, at = (out, m.end()) if m else (out + 1, at + len(grammar.OPENER))
        return out

    assert column(spark, texts, lambda c: F.regexp_count(c, F.lit(grammar.MALFORMED))) == [plain(t) for t in texts]
