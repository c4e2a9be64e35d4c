"""Graph, url and vector operators, and the pipeline, against plain versions."""

import random

import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from refloom.llm import scratch, urlfilter, vafile
from refloom.llm.components import components
from refloom.llm.q_urlfilter import RULES
from refloom.llm.urlfilter import Rule


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    extra = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(35)]
    edges = [*chain, *star, *extra, (5, 5), (None, 3), *chain[:3]]
    rows = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[find(a)] = find(b)
    groups, want = {}, {}
    for r in rows:
        groups.setdefault(r.root, set()).add(r.node)
    for x in [x for e in edges for x in e if x is not None and any(x in f and f[0] != f[1] and None not in f for f in edges)]:
        want.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_rules_and_aliases(spark):
    pages = [
        (1, "https://A.example.com/en/5?x=1", None), (2, "http://example.com/en/71", ""), (3, None, None), (4, "no scheme", None),
        (5, "http://n.example.net/de/81#t", None), (6, "http://q.net/de/9", None), (7, "http://x.org/aa", '<link rel="canonical" href="http://b.example.com/en/1">'),
        (8, "http://www.x.org/aa/?utm_source=f", None), (9, "http://y.org/z", "<meta http-equiv='refresh' content='0; url=http://x.org/aa.html'>"), (10, "http://y.org/other", None),
        (11, "http://t.org/p", '<LINK href="/q" REL=canonical>'), (12, "http://t.org/q", None), (12, "http://t.org/q", None),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://t.org/q", "http://example.com/en/7"), ("http://t.org/q", "http://c.com/en/")], "url string, target string")
    rows = {r.page_id: r for r in urlfilter.judge(frame, RULES, redirects=redirects).collect()}
    assert {i: r.verdict for i, r in rows.items()} == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block", 6: "allow", 7: "block", 8: "block", 9: "block", 10: "allow", 11: "allow", 12: "allow"}
    assert (rows[1].host, rows[1].path, rows[1].rule) == ("a.example.com", "/en/5", "com/en/")
    assert (rows[3].host, rows[3].path, rows[3].rule) == ("", "", None)
    assert rows[7].rule is None and rows[5].rule == "example.net/de/8"
    clash = frame.selectExpr("*", "'x' as inherited", "'x' as verdict", "'x' as host")
    assert {r.page_id: r.verdict for r in urlfilter.judge(clash, RULES, redirects=redirects).collect()} == {i: r.verdict for i, r in rows.items()}
    assert urlfilter.judge(frame.limit(0), [Rule("block", "com/")]).count() == 0


def test_relative_links(spark):
    """Targets are seen from the page or its base; the verdicts here come from the links alone."""
    link = '<link rel="canonical" href="{}">'
    turn = "<meta http-equiv=refresh content=\"0; url='{}'\">"
    cases = [
        ("http://h.net/d/a?x=1#y", link.format("b.html"), "http://h.net/d/b.html"), ("http://h.net/d/e/a", link.format("../b"), "http://h.net/d/b"),
        ("http://h.net/d/a", link.format("./x/./y/../z/.."), "http://h.net/d/x/"), ("http://h.net", link.format("b"), "http://h.net/b"),
        ("http://h.net/d/a?x=1", link.format("?id=2&amp;k=3"), "http://h.net/d/a?id=2&k=3"), ("http://h.net/d/a", link.format("../../../b?q=/../c"), "http://h.net/b?q=/../c"),
        ("https://h.net/d/a", link.format("//k.org/p"), "https://k.org/p"), ("http://h.net/d/a", turn.format("http://k.org/../p"), "http://k.org/p"),
        ("http://h.net/d/a", turn.format("c?u=http://z.z/"), "http://h.net/d/c?u=http://z.z/"), ("http://h.net/d/a", '<base href="/e/f/">' + link.format("g"), "http://h.net/e/f/g"),
        ("http://h.net/d/a", link.format("mailto:x@y"), None), ("no scheme", link.format("b"), None), ("http://h.net/d/a", link.format(""), None),
        ("http://h.net/" + "d/" * 3000, link.format("b"), "http://h.net/" + "d/" * 3000 + "b"),
    ]
    for url, html, want in cases:
        got = urlfilter.page_edges(spark.createDataFrame([(url, html)], "url string, html string"), "url", "html").collect()
        assert [r.target for r in got] == ([] if want is None else [want]), (url, html)
    pages = spark.createDataFrame([(1, "http://h.net/d/a", link.format("b.html")), (2, "http://h.net/d/c", None)], "page_id long, url string, html string")
    judged = urlfilter.judge(pages, [Rule("block", "h.net/d/b")]).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in judged} == {1: (None, "block"), 2: (None, "allow")}


def test_exact_search(spark):
    rng = random.Random(2)
    vectors = [[rng.gauss(0, 0.2) for _ in range(16)] for _ in range(700)]
    vectors[50:60] = [vectors[0]] * 10  # ties
    rows = [(i, v) for i, v in enumerate(vectors)] + [(700, None), (750, [float("nan")] * 16), (800, [None] + [0.1] * 15), (850, [float("inf")] * 16), (900, [0.1] * 3), (7, vectors[7]), (950, []), (50, vectors[61]), (100, vectors[100])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    index = vafile.build(frame, "vec_id", "embedding")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in vafile.search(index, index.where("id % 50 = 0"), 5).collect()]
    import math

    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and None not in v and all(map(math.isfinite, v))]
    want = []
    for q in {i for i, _ in whole if i % 50 == 0}:
        ranked = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for j, a in whole if j == q for i, b in whole if i != q and len(b) == len(a))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    assert sorted(got) == sorted(want)
    assert vafile.search(index.limit(0), index.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(3)
    words = "river stone window garden yellow seven market quiet paper".split()
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    leak = prose(40)
    texts = [prose(120) + (" you worthless idiot" if i % 4 == 3 else "") for i in range(120)]
    texts += [texts[0], texts[4], leak + " " + prose(20), None, ""]
    texts.append(" ".join([prose(1500), *leak.split()[5:20], prose(1500)]))  # one window and a little more in a long text
    near = texts[8].split()
    near[30], near[90] = "other", "words"
    texts.append(" ".join(near))
    docs = [(i, t, rng.choice(["en", "de"]), rng.choice(["src0", "src1", "src9"]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 3)) for i in range(110)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    sf = f"file://{tmp_path}"
    now = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{sf}/out-{name}"
        stage(spark, now, sf).write.parquet(out)
        now = spark.read.parquet(out)
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
    clean = {i for i in range(127) if not (i < 120 and i % 4 == 3)}
    assert kept["toxicity"] == clean
    assert kept["near_duplicates"] == clean - {120, 121, 124, 126}  # copies of 0 and 4, a near copy of 8; the empty text joins the null one
    assert kept["decontamination"] == kept["near_duplicates"] - {122, 125}
    assert kept["mixing"] < kept["decontamination"] and len(kept["mixing"]) > 0.8 * len(kept["decontamination"])
    assert kept["sharding"] == kept["mixing"] and set(now.columns) >= {"doc_id", "text", "lang", "source", "n_chars", "shard"}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == kept["sharding"]


def test_pipeline_scores_few_texts_at_a_time(spark, tmp_path, monkeypatch):
    """A text that goes to Python with over BATCH_ROWS others would be dropped here, when the caller writes the stage as when it counts it."""
    most, path = scratch.BATCH_ROWS, str(tmp_path / "documents.parquet")
    spark.range(5 * most).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text")).coalesce(1).write.parquet(path)

    def score(docs, model, out):
        @F.pandas_udf("double")
        def crowded(texts: pd.Series) -> pd.Series:
            return pd.Series([float(len(texts) > most)] * len(texts))

        return docs.withColumn(out, crowded("text"))

    monkeypatch.setattr(corpus_pipeline, "load", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "train", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "score", score)
    before = {key: spark.conf.get(key) for key in scratch._BATCHES}
    assert corpus_pipeline.drop_toxic(spark, spark.read.parquet(path), "").count() == 5 * most
    assert {key: spark.conf.get(key) for key in scratch._BATCHES} == before
