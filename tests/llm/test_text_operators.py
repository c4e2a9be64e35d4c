"""Operators over texts, held against plain versions on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from refloom.llm import decontaminate, mixing, pii, quality, sharding, simhash, tokenstore

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone window garden yellow seven market quiet paper".split()


def docs(spark, texts, ids=None):
    rows = [(i, t, "en", "src0", 0) for i, t in zip(ids if ids is not None else range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


EDGES = [None, "", "  \n ", "x", "a b", "A B", "long " * 30_000, "é ß \U0001f980 " * 3]


def plain_print(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(1)
    for text in [*EDGES[:6], EDGES[7], *(prose(rng, n) for n in (3, 4, 50, 600))]:
        assert simhash.fingerprint(text) == plain_print(text)


def brute_groups(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_links_in_crowded_buckets(spark, monkeypatch):
    """Dense neighbourhoods go through all three partitions and lose nothing."""
    monkeypatch.setattr(simhash, "CROWD", 4)
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(60)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = [(r.lo, r.hi) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_near_duplicate_groups(spark):
    rng = random.Random(3)
    base = [prose(rng, 300) for _ in range(5)]
    texts = [*EDGES, *base, *base, *(b + " tail" for b in base)]
    rows = {r.id: r for r in simhash.groups(docs(spark, texts)).collect()}
    prints = [plain_print(t) for t in texts]
    assert [rows[i].component_id for i in range(len(texts))] == brute_groups(prints)
    assert simhash.groups(docs(spark, [])).count() == 0
    kept = simhash.keep_one(docs(spark, texts))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_groups(prints)))


def test_query_of_groups(spark, tmp_path):
    """op1's query as registered: its columns, leading zeros and the top bit of fingerprints included."""
    from refloom.llm.queries import QUERIES

    rng = random.Random(5)
    base = [prose(rng, n) for n in range(3, 63)]
    texts = [*EDGES, *base, *base[:9], *(b + " tail" for b in base)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op1_simhash"](spark, str(tmp_path))
    assert [*found.dtypes[:3]] == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    prints = [plain_print(t) for t in texts]
    assert any(p >> 63 for p in prints) and any(not p >> 60 for p in prints[len(EDGES) :])
    want = [(i, f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, brute_groups(prints), strict=True))]
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found.collect()) == want


def test_keep_one_with_repeated_and_null_ids(spark):
    rng = random.Random(4)
    a, b = prose(rng, 80), prose(rng, 80)
    frame = docs(spark, [a, a, b, b, b, a], [7, 7, 9, None, None, 8])
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(frame).collect()) == sorted([(7, a), (9, b)])
    assert simhash.keep_one(docs(spark, [a, a], [None, None])).count() == 1


def jaccard(a, b):
    def shingles(t):
        ws = t.lower().split()
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or {tuple(ws)}

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_near_copies(spark, monkeypatch):
    """Texts with five-word shingles alike at 0.8 share a group, through others too; nothing else does. Small and crowded keys alike."""
    rng = random.Random(21)
    alphabet = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(900)]
    word = lambda: alphabet[int(len(alphabet) * rng.random() ** 2)]
    base = [[word() for _ in range(rng.randrange(60, 400))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base[:40] + base[:2] * 60:
        edited = list(b)
        for _ in range(max(1, len(b) // rng.choice([60, 80, 150]))):
            edited[rng.randrange(len(edited))] = word()
        texts.append(" ".join(edited))
    texts += [texts[3], texts[3].upper(), None, "", "a b", "A  b", "v " * 40_000]
    frame = docs(spark, texts).withColumn("row", F.lit("clash")).withColumn("id", F.lit(5)).withColumn("node", F.lit(None).cast("string"))
    n = len(texts)
    pairs = [(i, j) for i in range(n) for j in range(i) if texts[i] and texts[j] and len(texts[i]) < 9999 and len(texts[j]) < 9999 and jaccard(texts[i], texts[j]) >= 0.8]
    groups = {r.id: r.root for r in simhash.near_groups(frame).collect()}
    caught = np.mean([groups[i] == groups[j] for i, j in pairs])
    assert len(pairs) > 800 and caught >= 0.95, caught
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in [*pairs, (n - 4, n - 5), (n - 2, n - 3)]:
        root[find(i)] = find(j)
    assert all(find(i) == find(j) for i in range(n) for j in range(i) if groups[i] == groups[j])
    kept = simhash.keep_one_near(frame)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted({min(i for i in range(n) if groups[i] == g) for g in groups.values()})


def test_near_copies_lose_no_group(spark):
    """Groups are those of brute force where keys are crowded: sliding windows whose ends are unlike, a large group edited at the bound, a shared passage."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    long, core, passage = ([word() for _ in range(n)] for n in (900, 120, 60))
    texts = [" ".join(long[i : i + 200]) for i in range(0, 700, 12)]
    for n_edits in [3] * 20 + [2] * 20 + [4] * 20:
        edited = list(core)
        for at in rng.sample(range(120), n_edits):
            edited[at] = word()
        texts.append(" ".join(edited))
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(1, 20))]) for _ in range(60)]
    rng.shuffle(texts)
    n = len(texts)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if find(i) != find(j) and jaccard(texts[i], texts[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = {r.id: r.root for r in simhash.near_groups(docs(spark, texts)).collect()}
    want, got = {}, {}
    for i in range(n):
        want.setdefault(find(i), []).append(i)
        got.setdefault(groups[i], []).append(i)
    assert max(map(len, want.values())) >= 50 and len(want) >= 5
    assert sorted(got.values()) == sorted(want.values())


def test_near_copies_defined_cases(spark):
    rng = random.Random(22)
    a, b = prose(rng, 80), prose(rng, 80)
    frame = docs(spark, [a, a, b, b, b, a, None, None], [7, 7, 9, None, None, 8, None, 3])
    assert sorted((r.doc_id, r.text or "") for r in simhash.keep_one_near(frame).collect()) == sorted([(7, a), (9, b), (3, "")])
    assert simhash.keep_one_near(frame.limit(0)).count() == 0
    clash = frame.withColumn("id", F.lit(1)).withColumn("fp", F.lit("x"))
    assert sorted((r.doc_id, r.text or "") for r in simhash.keep_one(clash).where("doc_id is not null").collect())[0][0] == 3


def plain_windows(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    n = min(13, len(words))
    return words, {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def plain_judge(text, items):
    words, hit, held = plain_windows(text)[0], set(), set()
    for item, body in items:
        for w in plain_windows(body)[1]:
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    held.add(str(item))
    digest = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
    return len(words), len(hit), len(held), digest, bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, n)) for i, n in enumerate([40, 13, 14, 12, 5, 3, 2, 1, 60])] + [(20, None), (21, " . "), (22, "same " * 30)]
    items.append((23, items[0][1]))
    pick = lambda: items[rng.randrange(9)][1]
    texts = [*EDGES, "same " * 50, *(f"{prose(rng, 30)} {pick().upper()}! {prose(rng, 20)} {pick()}" for _ in range(25)), items[0][1][: len(items[0][1]) // 2]]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.judge(docs(spark, texts), frame).collect()}
    assert got == {i: plain_judge(t, items) for i, t in enumerate(texts)}
    assert {r.n_hit for r in decontaminate.judge(docs(spark, texts[-3:]), frame.limit(0)).collect()} == {0}
    assert decontaminate.judge(docs(spark, []), frame).count() == 0


def test_decontamination_row_by_row(spark, monkeypatch):
    """Null and repeated ids are judged by their own texts, and a benchmark beyond the broadcast bound gives the same rows."""
    rng = random.Random(15)
    items = [(i, prose(rng, n)) for i, n in enumerate([40, 13, 5, 2, 1, 25])]
    texts = [items[0][1], prose(rng, 30), f"{prose(rng, 9)} {items[5][1]}", f"{prose(rng, 400)} {items[1][1]} {prose(rng, 400)}", "a b c d"]
    frame = docs(spark, [*texts, *texts], [None, None, 3, 3, 3, *range(10, 15)]).withColumn("id", F.lit("clash")).withColumn("row", F.lit(0)).withColumn("w", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, [(i, *plain_judge(t, items)) for i, t in zip([None, None, 3, 3, 3, *range(10, 15)], [*texts, *texts], strict=True)]))
    for bound in (decontaminate.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
        got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.judge(frame, bench).collect()]
        assert sorted(map(str, got)) == want


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0, "phone": 10 <= len(digits) <= 15}
            if ok[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_personal_data(spark):
    rng = random.Random(6)
    parts = ["a.b@c.de", "x@y", "@", "10.0.0.255", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (202) 555-0100", "+12", "é\U0001f980", " ", ".", "_", "0" * 30, "a@b.c_d@e.fg", "text"]
    texts = [*EDGES, *("".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(12)) for _ in range(150)), "a.b@" * 500, "9" * 5000]
    rows = pii.find(docs(spark, texts)).select("id", pii.listed(F.col("base")).alias("base")).collect()
    assert {r.id: r.base for r in rows} == {i: plain_spans(t) for i, t in enumerate(texts)}
    assert pii.find(docs(spark, [])).count() == 0


def test_personal_data_of_many_matches(spark):
    """Positions hold beyond the blocks of the running sums, at their edges and after astral characters."""
    texts = ["\U0001f980 " + " ".join(f"a{i}@b.c 1.2.3.{i % 300} +1202555{i:04d}" for i in range(n)) for n in (1, 63, 64, 65, 128, 4097, 9000)]
    rows = pii.find(docs(spark, texts)).select("id", pii.listed(F.col("base")).alias("base")).collect()
    assert {r.id: r.base for r in rows} == {i: plain_spans(t) for i, t in enumerate(texts)}


def test_disclosing_terms(spark):
    rng = random.Random(7)
    told = [f"{prose(rng, 5)} the lighthouse keeper writes from ann@lamp.org about {w}" for w in ("boats", "storms", "birds", "tides")]
    texts = [*told, *(f"{prose(rng, 8)} writes about the weather" for _ in range(60))]
    found = {r.id: r.spans for r in pii.find(docs(spark, texts)).collect()}
    terms = {texts[i][s["start"] : s["end"]] for i, spans in found.items() for s in spans if s["rank"] == 4}
    assert {"lighthouse", "keeper"} <= terms and not terms & {"writes", "about"}
    clean = {r.doc_id: r.sanitised for r in pii.sanitise(docs(spark, texts)).collect()}
    assert "ann@lamp.org" not in clean[0] and "<email>" in clean[0] and "lighthouse" not in clean[0] and clean[10] == texts[10]


def spoken(spark, texts):
    """The words flagged as terms, by document."""
    found = pii.find(docs(spark, texts)).collect()
    return {r.id: [texts[r.id][s["start"] : s["end"]] for s in r.spans if s["rank"] == 4] for r in found}


def test_terms_of_entities_in_one_text(spark):
    rng = random.Random(13)
    rest = [f"{prose(rng, 8)} writes about the weather" for _ in range(60)]
    terms = spoken(spark, ["the zeppelin captain writes from ann@lamp.org about weather", *rest])
    assert terms[0] == ["zeppelin", "captain", "from"] and not any(terms[i] for i in range(1, 61))
    assert not any(spoken(spark, ["write to ann@lamp.org today", "call ann@lamp.org tomorrow"]).values())  # no surprise


def test_terms_far_from_the_entity_and_without_it(spark):
    rng = random.Random(14)
    told = [f"\u00e9\U0001f980 ann@lamp.org {prose(rng, 40)} Lighthouse. {prose(rng, 300)} lighthouse" for _ in range(4)]
    texts = [*told, f"{prose(rng, 50)} (LIGHTHOUSE) {prose(rng, 3)}", *(prose(rng, 60) for _ in range(200))]
    terms = spoken(spark, texts)
    assert [terms[i] for i in range(6)] == [["Lighthouse", "lighthouse"]] * 4 + [["LIGHTHOUSE"], []]
    clean = {r.doc_id: r.sanitised for r in pii.sanitise(docs(spark, texts)).collect()}
    assert not any("lighthouse" in clean[i].lower() for i in range(5)) and "(<term>)" in clean[4]


def test_sharding(spark):
    rng = random.Random(8)
    texts = [*EDGES, *(prose(rng, rng.randrange(30)) for _ in range(1500)), *["twin"] * 300]
    ids = [*range(len(texts) - 300), *[5] * 299, None]
    frame = docs(spark, texts, ids).withColumn("shard", F.lit("clash")).withColumn("size", F.lit(0))
    placed = sharding.assign(frame, "doc_id", 16)
    rows = sharding.number(placed.select("doc_id", "size", "text_crc32", "law", "shard", "grown_shard"), "shard", ["doc_id", "text_crc32", "size"]).collect()
    assert len(rows) == len(texts)
    for shard in range(16):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and 40 < sum(r.grown_shard == 16 for r in rows) < 140
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1
    by_text = {(r.size, r.text_crc32) for r in rows}
    assert by_text == {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts}
    assert sharding.number(sharding.assign(docs(spark, []), "doc_id").select("doc_id", "shard"), "shard", ["doc_id"]).count() == 0
    heavy = sharding.assign(docs(spark, ["x"] * 2000), "doc_id", 2, [1.0, 3.0]).groupBy("shard").count().collect()
    assert 1400 < {r.shard: r["count"] for r in heavy}[1] < 1600


def test_mixing_budgets(spark):
    leaves = spark.createDataFrame([("a", "x", 100), ("a", "y", 1000), ("b", "x", 50), ("b", None, 50)], "d string, l string, unique long")
    got = {(r.d, r.l): r.given for r in mixing.budgets(leaves, ["d", "l"], {"d": {"a": 1, "b": 1}}, F.lit(800), 1).collect()}
    # b can hold 100 of its 400; a takes the rest; in a, x is full and its shortage goes to y
    assert got == {("a", "x"): 100, ("a", "y"): 600, ("b", "x"): 50, ("b", None): 50}
    got = mixing.budgets(leaves, ["d", "l"], {"d": {"b": 0}}, F.lit(800), 1).collect()
    assert {r.d: r.given for r in got if r.d == "b"} == {"b": 0}


def test_mixing_prefixes(spark):
    rng = random.Random(9)
    frame = docs(spark, [*EDGES, *(prose(rng, rng.randrange(1, 60)) for _ in range(300))])
    level = {"lang": F.col("lang")}
    half = mixing.mix(frame, level, {}, (1, 2), 1).collect()
    all_tokens = mixing.mix(frame, level, {}, (1, 1), 1, all_rows=True).agg(F.sum("n_tokens")).first()[0]
    kept = sum(r.n_tokens for r in half)
    assert all_tokens // 2 <= kept + 60 and len({r.id for r in half}) == len(half)
    thrice = {r.id: r.copies for r in mixing.mix(frame, level, {}, (3, 1), 4).collect()}
    assert set(thrice.values()) == {3}
    assert mixing.mix(docs(spark, []), level, {}).count() == 0


def tokenizer_path():
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def test_token_store(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(10)
    long = prose(rng, 5000)
    texts = [*EDGES, long, long, "start " + long, "Don't STOP<|endoftext|> Éa's 1,000.5%% İx ΣΑΣ", "x\x85y z"]
    ids = [*range(len(texts) - 2), 3, None]
    path = f"file://{tmp_path}/store"
    tokenstore.write(docs(spark, texts, ids), path, tokenizer_path(), 2)
    plain = Tokenizer.from_file(tokenizer_path())
    streams = [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    want, start = [], 0
    for i in sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or 0, i)):
        want.append((ids[i], start, len(streams[i]), zlib.crc32(np.array(streams[i], dtype="<u4").tobytes())))
        start += len(streams[i])
    got = [(r.id, r.start, r.n_tokens, r.ids_crc32) for r in tokenstore.checksums(spark, path).orderBy("start").collect()]
    assert got == want
    assert tokenstore.damaged(spark, path).count() == 0
    back = {r.start: r.ids for r in tokenstore.restore(spark, path).collect()}
    assert [back[w[1]] for w in want if w[0] == 4][0] == streams[4]
    stored = tokenstore.chunks(spark, path).agg(F.sum("n")).first()[0]
    assert stored < sum(map(len, streams)) - len(streams[8])  # the copy is stored once
    empty = f"file://{tmp_path}/empty"
    tokenstore.write(docs(spark, []), empty, tokenizer_path(), 2)
    assert tokenstore.checksums(spark, empty).count() == 0


def test_ids_equal_the_library(tmp_path):
    """Words through the merges, with marks, in other scripts, and texts of odd characters."""
    from tokenizers import Tokenizer

    rng = random.Random(23)
    plain, code = Tokenizer.from_file(tokenizer_path()), tokenstore.Encoder(tokenizer_path())
    assert code.merges is not None
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "\u00e9\u00e8\u00fc\u00df\u00f1\u00c9\u00aa\u00b5"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14)))
    odd = ["'s", "don't", "1,000.5%", "<|endoftext|>", "\u0130x", "\u03a3\u0391\u03a3", "\x85", "e\u0301", "\u4f60\u597d", "\U0001f980", "", "\t", "\u2028", "--", "a_b", "x" * 300]
    texts = [None, "", " ", "\n\n", *("".join(rng.choice([word(), word() + rng.choice("!?.,;%%%"), rng.choice(odd)]) + rng.choice([" ", " ", "\n", "  "]) for _ in range(30)) for _ in range(300))]
    ids, ends = code(texts, 2)
    for text, a, b in zip(texts, [0, *ends[:-1]], ends, strict=True):
        assert ids[a:b].tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 2], text
    code.merges = None
    again, _ = code(texts, 2)
    assert (again == ids).all()


@pytest.mark.parametrize("lost", ["recipes", "manifest", "parts"])
def test_a_lost_group_is_noticed(spark, tmp_path, lost):
    path = f"file://{tmp_path}/store"
    tokenstore.write(docs(spark, [f"some words here {i}" for i in range(20)]), path, tokenizer_path(), 2)
    rows = spark.read.parquet(f"{path}/{lost}")
    kept = spark.createDataFrame([r for r in rows.collect() if r["part"] != 1], rows.schema)
    kept.write.mode("overwrite").parquet(f"{path}/{lost}")
    with pytest.raises(ValueError, match="damaged"):
        tokenstore.checksums(spark, path)


def test_a_damaged_store_is_an_error(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    tokenstore.write(docs(spark, ["some words here"]), path, tokenizer_path(), 2)
    good = tokenstore.chunks(spark, path)
    rows = [(r["hash"], r["n"], b"\xff" + bytes(r["ids"][1:])) for r in good.collect()]
    spark.createDataFrame(rows, good.schema).write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="damaged"):
        tokenstore.checksums(spark, path).collect()


def test_quality(spark):
    rng = random.Random(12)
    make = [lambda: " ".join(rng.choice(["%%%", "###", "zz"]) for _ in range(40)), lambda: prose(rng, 40) + " clown", lambda: prose(rng, 40)]
    grades = [i % 3 for i in range(450)]
    texts = [make[g]() for g in grades]
    model = quality.fit(texts[:300], grades[:300], 3)
    assert model.thresholds[0] < model.thresholds[1]
    frame = docs(spark, [*EDGES, *texts[300:]]).withColumn("expected_grade", F.lit("clash"))
    rows = {r.doc_id: r for r in quality.score(frame, model, 1).collect()}
    assert len(rows) == len(EDGES) + 150
    means = [np.mean([rows[len(EDGES) + i].expected_grade for i in range(150) if grades[300 + i] == g]) for g in range(3)]
    assert means[0] < 0.3 < means[1] < means[2]
    keep = [(rows[len(EDGES) + i].tail_probability >= 0.5) == (grades[300 + i] >= 1) for i in range(150)]
    assert np.mean(keep) > 0.95
    assert quality.fit([], [], 3).tails(np.zeros(1)).shape == (1, 2)
