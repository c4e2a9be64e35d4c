"""Scanners, extractors, resolution and the gate on small trees."""

import json
import os
import subprocess
from collections import Counter

import pytest
from pyspark.sql import functions as F

from refloom.api import Engine, Status
from refloom.operators import extract, lines, render, resolve, scan, verify
from refloom.sources import index as store
from refloom.sources import refidx, tree
from refloom.sources.config import Config, parse
from refloom.sources.globs import in_scope
from refloom.streaming import reindex

#: How often the made page breaks each rule.
BROKEN = {"dangling-marker": 3, "ambiguous-marker": 2, "path-only-marker": 1, "malformed-marker": 4, "path-line": 2, "stale-mention": 3}
_BREAK = {
    "dangling-marker": "[[rr:missing {i}]]",
    "ambiguous-marker": "[[rr:Twice]]",
    "path-only-marker": "[[rr:kit/box.rs]]",
    "malformed-marker": "[[rr:stuck {i}",
    "path-line": "kit/box.rs:{i}4",
    "stale-mention": "kit/lost{i}.rs",
}
PAGE = "# Page\n" + "".join(f"\nNo {i}, {_BREAK[rule].format(i=i)}\n" for rule, n in BROKEN.items() for i in range(n))
PAGE += "\nRight: [[rr:one.md#Twice]] kit/box.rs, he/she, A/B.\n\n~~~\n[[rr:kept out]] kit/out.rs kit/box.rs:5\n~~~\n"
TREE = {"page.md": PAGE, "kit/box.rs": "fn lid() {}\n", "one.md": "## Twice\nx\n", "two.md": "## Twice\ny\n"}
BOTH = {"python": ["comments"], "rust": ["comments"]}


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def found(spark, content, path="x.md", scan_config=None):
    rows = scan.hits(frame(spark, {path: content}), scan_config).orderBy(*scan.ORDER).collect()
    return [f"{r.line}:{r.hit}:{r.anchor or r.token or ''}{':line' if r.line_ref else ''}".rstrip(":") for r in rows]


def test_regions(spark):
    cases = [
        ("see [[rr:A]] and `[[rr:B]]` and `x [[rr:C]]`\n", "x.md", None, ["1:marker:A", "1:marker:B"]),
        ("[[rr:a]]\n```\n[[rr:f]]\n~~~\nsrc/f.rs\n```\n[[rr:b]]\n", "x.md", None, ["1:marker:a", "7:marker:b"]),
        ("```\n[[rr:x]]\n```\n", "x.txt", None, ["2:marker:x"]),
        ("src/cli.rs, not `src/o.rs`, and/or\n", "x.md", None, ["1:mention:src/cli.rs", "1:mention:and/or"]),
        ("[[rr:src/cli.rs#p]] narrows\n", "x.md", None, ["1:marker:src/cli.rs#p"]),
        ("at src/cli.rs:42 in doc/ad.\n", "x", None, ["1:mention:src/cli.rs:line", "1:mention:doc/ad"]),
        ("s = \"[[rr:A]] d/x.md\"  # [[rr:B]] d/y.md\n", "x.py", BOTH, ["1:marker:B", "1:mention:d/y.md"]),
        ('"""\n# [[rr:x]]\n"""\n# [[rr:y]]\n', "x.py", BOTH, ["4:marker:y"]),
        ("/*\nsee [[rr:x]]\n*/ a /* b */ // [[rr:y]]\n", "x.rs", BOTH, ["2:marker:x", "3:marker:y"]),
        ("/* /* */ [[rr:o]] */\n", "x.rs", BOTH, []),
        ('let r = r##"a "# b"##; // [[rr:f]]\n', "x.rs", BOTH, ["1:marker:f"]),
        ("fn f<'a>(x: &'a str, q: char) {'\"'} // [[rr:g]]", "x.rs", BOTH, ["1:marker:g"]),
    ]
    for content, path, config, want in cases:
        assert found(spark, content, path, config) == want, content


def test_lines_follow_their_ends(spark):
    rows = lines.lines(frame(spark, {"a": "x\r\ny\n", "b": "", "c": "\n", "d": "x\r"})).orderBy("path", "line").collect()
    assert [(r.path, r.line, r.text) for r in rows] == [("a", 1, "x"), ("a", 2, "y"), ("c", 1, ""), ("d", 1, "x\r")]


def test_definitions(spark):
    files = {
        "g.md": "# Guide\n\nintro\n## Config\n\nbody\n```\n# no\n```\n# Next: x\n",
        "x.feature": "Feature: F\n  \"\"\"json\n  Scenario: hidden\n  \"\"\"\n  Scenario: A\n    Given x\n  Scenario Outline: B\n",
        "x.rs": "fn open_lid() {\n    let s = \"}\";\n}\nstruct Crate;\ntrait T {\n    fn sig(&self);\n}\n",
        "x.py": "@d\ndef weigh():\n    pass\n\nclass Shelf:\n    async def carry(self):\n        pass\n",
        "bad.py": "def broken(:\n    x\n\nclass C:\n    pass\n",
        "n.md": None,
    }
    got = {(r.file, r.anchor, r.start_line, r.end_line) for r in extract.anchors(frame(spark, files)).collect()}
    assert got == {
        ("g.md", "Guide", 1, 9), ("g.md", "Config", 4, 9), ("g.md", "Next: x", 10, 10), ("x.feature", "F", 1, 7), ("x.feature", "A", 5, 6), ("x.feature", "B", 7, 7),
        ("x.rs", "open_lid", 1, 3), ("x.rs", "Crate", 4, 4), ("x.rs", "T", 5, 7), ("x.py", "weigh", 2, 3), ("x.py", "Shelf", 5, 7), ("x.py", "carry", 6, 7), ("bad.py", "broken", 1, 2), ("bad.py", "C", 4, 5),
    }


def test_nest_and_ties(spark):
    forward = spark.createDataFrame([("outer", "f", 1, 9), ("a", "f", 3, 5), ("b", "f", 3, 5), ("else", "g", 1, 9)], "anchor string, file string, start_line long, end_line long")
    at = spark.createDataFrame([("f", 4)], "file string, line long")
    assert [(r.anchor, r.innermost) for r in resolve.nest(at, forward).orderBy("depth").collect()] == [("outer", False), ("a", True), ("b", True)]
    assert {r.marker for r in resolve.locate(at, forward).collect()} == {"[[rr:a]]", "[[rr:b]]"}


def test_six_kinds(spark):
    files = frame(spark, TREE)
    rows = verify.findings(files.where("path = 'page.md'"), extract.anchors(files), verify.entries_of(files))
    assert dict(Counter(r.rule for r in rows.collect())) == BROKEN
    told = json.loads(render.verify_document(rows).first()["json"])
    assert (told["format"], told["version"], told["command"]) == ("rr-json", 1, "verify")
    assert [sorted(f) for f in told["data"]["findings"]] == [["file", "line", "rule"]] * sum(BROKEN.values())
    assert [f["line"] for f in told["data"]["findings"]] == sorted(f["line"] for f in told["data"]["findings"])
    none = verify.findings(files, extract.anchors(files), verify.entries_of(files), ())
    assert none.isEmpty() and json.loads(render.verify_document(none).first()["json"])["data"] == {"findings": []}
    with pytest.raises(ValueError, match="unknown verify rule"):
        verify.findings(files, files, files, ("typo",))


@pytest.fixture
def root(tmp_path):
    for path, content in {**TREE, ".hidden.md": "[[rr:x]]", "skip/me.md": "# No\n", ".gitignore": "skip/\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    (tmp_path / "bin.md").write_bytes(b"\xff\xfe# x")
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    return tmp_path


def test_verbs(spark, root):
    engine = Engine(spark, str(root), str(root / ".idx"))
    assert engine.read("Twice").status == Status.STALE
    assert engine.index().message.startswith("indexed 4 anchors and ")
    assert engine.read("Twice").status == Status.ADVERSE
    assert engine.read("[[rr:stuck").status == Status.USAGE
    unique = engine.read("[[rr:one.md#Twice]]")
    assert (unique.status, engine.lines(unique, "read")) == (Status.OK, "one.md:1-2")
    at = engine.at("one.md:2")
    assert (at.status, engine.lines(at, "at")) == (Status.OK, "[[rr:one.md#Twice]]")
    shown = json.loads(render.at_document(at.rows).first()["json"])["data"]["anchors"]
    assert shown == [{"anchor": "one.md#Twice", "marker": "[[rr:one.md#Twice]]", "location": {"file": "one.md", "start_line": 1, "end_line": 2}}]
    assert engine.at("kit/box.rs:9").status == Status.ADVERSE
    assert engine.at("nowhere").status == Status.USAGE
    twice = engine.search("Twice")
    assert twice.rows.count() == 3 and engine.lines(twice, "search").endswith("\n3 markers")
    assert engine.search("none").status == Status.ADVERSE
    assert engine.search(mentions=True, paths=["page.md", "./page.md"]).status == Status.OK
    assert engine.search(paths=["gone.md"]).status == Status.USAGE
    gate = engine.verify()
    assert gate.status == Status.ADVERSE and gate.rows.count() == sum(BROKEN.values())
    text = engine.lines(gate, "verify")
    assert "page.md:3: dangling marker: [[rr:missing 0]]" in text and text.endswith(f"\n{sum(BROKEN.values())} findings")
    assert Engine(spark, str(root), str(root / ".idx"), Config(exclude=("page.md",))).verify().status == Status.OK
    os.utime(root / "one.md", (2**31, 2**31))
    assert engine.read("one.md#Twice").status == Status.STALE
    assert engine.read("one.md#Twice", skip_freshness=True).status == Status.OK


def test_long_section_lists(spark):
    """Many headings in one file, against a plain scan."""
    ranks = [1 + (i * 7) % 5 for i in range(3000)]
    files = frame(spark, {"long.md": "".join("#" * r + f" T{i}\n" for i, r in enumerate(ranks))})
    got = {r.anchor: r.end_line for r in extract.anchors(files).collect()}
    for i in range(0, 3000, 37):
        assert got[f"T{i}"] == next((j for j in range(i + 1, 3000) if ranks[j] <= ranks[i]), 3000)


def test_listing_and_globs(spark, root):
    assert [p for p, d in tree.listing(str(root)) if not d] == ["bin.md", "kit/box.rs", "one.md", "page.md", "two.md"]
    assert "skip/me.md" in [p for p, _ in tree.listing(str(root), ignore=False)]
    rows = spark.createDataFrame([(p,) for p in ("README.md", "doc/a/b.md", "src/x.rs", "tests/data/v.md")], "path string")
    assert {r.path for r in rows.where(in_scope(F.col("path"), ["**/*.md"], ["tests/data/**"])).collect()} == {"README.md", "doc/a/b.md"}


def test_config():
    got = parse('[verify]\nrules = ["path-line"] # c\n[scan.rust]\neligible = ["comments"]\n')
    assert got.rules == ("path-line",) and got.scan["rust"] == ["comments"] and got.in_scope == ("**/*.md",)


def test_text_index():
    image = refidx.Image([("b", "x:1-2"), ("a", "x:9-9"), ("a", "x:10-12")], [("t/u", "x:1-1")], ["x"], 7, "t")
    data = refidx.encode(image)
    assert data == refidx.encode(refidx.Image(image.forward[::-1], image.mentions, image.paths, 7, "t"))
    assert refidx.decode(data).forward == [("a", "x:10-12"), ("a", "x:9-9"), ("b", "x:1-2")]
    for broken in (b"", data[:-3], data.replace(b"v2", b"v1")):
        with pytest.raises(ValueError, match="corrupt"):
            refidx.decode(broken)


def test_incremental(spark, tmp_path):
    where = f"file://{tmp_path}/idx"
    reindex.upsert(frame(spark, {"a.md": "# One\n", "b.md": "# Two\n"}), where, 1)
    reindex.upsert(frame(spark, {"a.md": "# Three\nsee x/y\n", "b.md": None}), where, 2)
    now = store.read(spark, where)
    assert [(r.anchor, r.file) for r in now.forward.collect()] == [("Three", "a.md")]
    assert [r.token for r in now.mentions.collect()] == ["x/y"] and [r.path for r in now.paths.collect()] == ["a.md"]


def test_order_of_a_name_that_every_file_has(spark):
    """The whole index is numbered, and a run of one name is split over tasks."""
    rows = [("Details", f"d{i}.md", i % 7, 9) for i in range(3000)] + [(f"DOC-{i}", f"d{i}.md", 1, 9) for i in range(300)] + [("DOC-1", "d1.md", 1, 9)]
    forward = spark.createDataFrame(rows, "anchor string, file string, start_line long, end_line long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    numbered = resolve.ordered(forward).withColumn("task", F.spark_partition_id()).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted((a, f"{f}:{s}-{e}") for a, f, s, e in rows)
    assert [(r.anchor, r.location) for r in sorted(numbered, key=lambda r: r.position)] == want
    assert sorted(r.position for r in numbered) == list(range(1, len(rows) + 1))
    assert resolve.ordered(forward.limit(0)).count() == 0
    assert len({r.task for r in numbered if r.anchor == "Details"}) > 2
