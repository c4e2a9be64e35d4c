"""Personal data: patterns, and terms that give the protected entities away.

Base spans are matches of four patterns. The entities they name are protected:
by information-theoretic sanitisation, a term discloses an entity when knowing
the term removes most of the surprise of the entity. With document counts n over
N documents, a term t (of TERM_LETTERS letters at least) discloses entity e when

    PMI(e; t) = log2(n(e,t) N / (n(e) n(t)))  >=  ALPHA log2(N / n(e)),  and > 0

however few the documents of e. All its occurrences in all documents become
spans of kind "term": generalised to a placeholder, or removed where the term
always comes with the entity.

Everything is a DataFrame expression. Positions come from the pieces between the
matches. Patterns are written so that a long run of characters is scanned once:
a match starts at the beginning of a run or where the last match ended, which is
where the leftmost match starts in any case, and runs are taken whole.

Counts cover all documents and whole texts. Entities of the same documents are
one for the counts, and terms in too many documents to disclose any entity go
before (entity, term) pairs are made and counted with map-side combination.

Defined cases: a null text is empty and has no span; a very long text is read
whole; repeated rows are separate documents for n; an entity of all documents is
no surprise and nothing discloses it; failing matches are dropped and not tried
again at shorter lengths; an empty table gives an empty table; other columns pass
through ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.scratch import cut

KINDS = ("email", "ip", "card", "phone")
ALPHA = 0.8
TERM_LETTERS = 4
BROADCAST_ROWS = 200_000

_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_GUARDS = {"email": "@", "ip": ".", "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A word and what lies before it.
_UNIT = r"\P{L}*+\p{L}++"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        double = d * 2
        return F.when(i % 2 == 0, d).when(double > 9, double - 9).otherwise(double)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return text.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z")
    n = F.length(_digits(text))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(text))).otherwise(False)
    return n.between(10, 15)


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(numbers: Column, depth: int = 3) -> Column:
    """Running sums of an array of ints; blocks of 64 are summed first, so a number costs 64 additions a level at most."""
    total = lambda first, n: F.aggregate(F.slice(numbers, first, n), F.lit(0), lambda a, b: a + b)
    if depth == 0:
        return F.transform(numbers, lambda _, i: total(F.lit(1), i + 1))
    first = lambda block: F.shiftleft(block, 6) + 1
    blocks = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(numbers), 6)), lambda b: total(first(b), F.lit(64)))
    before = lambda sums, i: F.coalesce(F.get(sums, F.shiftright(i, 6) - 1), F.lit(0))
    within = lambda i: total(first(F.shiftright(i, 6)), i.bitwiseAND(63) + 1)
    return _let(_let(blocks, lambda b: running(b, depth - 1)), lambda sums: F.transform(numbers, lambda _, i: before(sums, i) + within(i)))


def _with_matches(df: DataFrame, text: str, pattern: str, out: str, tried: Column) -> DataFrame:
    """Add ``out``: array of (start, end, match) in code points, for the leftmost non-overlapping matches."""
    none = F.array().cast("array<string>")
    found = F.when(tried, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    span = lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match"))

    def spans(matches: Column) -> Column:
        # a match and the piece before it
        steps = F.zip_with(F.slice(F.split(text, pattern), F.lit(1), F.size(matches)), matches, lambda gap, m: F.length(gap) + F.length(m))
        return F.zip_with(_let(steps, lambda s: running(s)), matches, span)

    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return df.withColumn(out, _let(found, lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(empty)))


def _kept(kind: str) -> Column:
    """The valid matches of one kind as spans."""
    good = F.filter(f"_{kind}", lambda m: _valid(kind, m["match"]))
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), m["match"].alias("match")))


def count(spans: Column | str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("bigint")


def _base(df: DataFrame, text: str) -> DataFrame:
    """Add ``base``: array of (start, rank, end, match) over all kinds, in order."""
    for kind in KINDS:
        tried = F.instr(text, _GUARDS[kind]) > 0 if kind in _GUARDS else F.lit(True)
        if kind != "email":
            tried = tried & F.col("_numbers")
        df = _with_matches(df.withColumn("_numbers", F.col(text).rlike("[0-9]")) if "_numbers" not in df.columns else df, text, _PATTERNS[kind], f"_{kind}", tried)
    return df.withColumn("base", F.array_sort(F.concat(*map(_kept, KINDS)))).drop("_numbers", *[f"_{k}" for k in KINDS])


def _entity(rank: Column, match: Column) -> Column:
    """A protected entity: the kind and the match without regard to case or layout."""
    return F.xxhash64(rank, F.when(rank == KINDS.index("email"), F.lower(match)).when(rank == KINDS.index("ip"), match).otherwise(_digits(match)))


def _name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in (*KINDS, "term")]), rank + 1)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _name(s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _said(df: DataFrame, *kept: str) -> DataFrame:
    """A row for each document and each of its distinct words."""
    words = F.filter(F.array_distinct(F.split("text", r"\P{L}+")), lambda w: F.length(w) >= TERM_LETTERS)
    return df.select(*kept, F.explode(F.array_distinct(F.transform(words, lambda w: F.lower(w)))).alias("term"))


def _small(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _disclosing(found: DataFrame) -> DataFrame:
    """(seq, term, certain): the disclosing terms each document says; certain: the term never comes without its entity."""
    total = F.lit(float(max(found.count(), 1)))
    with_entity, others = found.where(F.size("base") > 0), found.where(F.size("base") == 0)
    held = cut(with_entity.select("seq", F.explode("base").alias("b")).select("seq", _entity(F.col("b.rank"), F.col("b.match")).alias("entity")).distinct(), "entities")
    # entities of the same documents disclose alike and count once; sets of documents are told apart by 128 bits
    sets = cut(held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.bit_xor(F.xxhash64("seq")).alias("set_a"), F.bit_xor(F.xxhash64("seq", F.lit(1))).alias("set_b")), "sets")
    kinds = cut(held.join(_small(sets), "entity").select("seq", "n_entity", "set_a", "set_b").distinct(), "kinds")
    # n_both is at most n_entity and n_term, so no term in more documents than this can reach the threshold
    most = lambda n: F.pow(total, F.lit(1 - ALPHA)) * F.pow(n, F.lit(ALPHA)) * (1 + 1e-9)
    reach = kinds.agg(most(F.max("n_entity"))).first()[0] or 0.0
    near = _said(with_entity).groupBy("term").agg(F.count(F.lit(1)).alias("n_near")).where(F.col("n_near") <= reach)
    far = _said(others).groupBy("term").agg(F.count(F.lit(1)).alias("n_far"))
    n_term = F.col("n_near") + F.coalesce("n_far", F.lit(0))
    terms = cut(near.join(far, "term", "left").select("term", n_term.alias("n_term"), F.col("n_far").isNotNull().alias("elsewhere")).where(F.col("n_term") <= reach), "terms")
    said = cut(_said(with_entity, "seq").join(_small(terms), "term"), "near")
    pairs = said.join(kinds, "seq").where(F.col("n_term") <= most(F.col("n_entity"))).groupBy("set_a", "set_b", "n_entity", "term", "n_term", "elsewhere").agg(F.count(F.lit(1)).alias("n_both"))
    pmi = F.log2(F.col("n_both") * total / (F.col("n_entity") * F.col("n_term")))
    told = pairs.where((pmi > 0) & (pmi >= ALPHA * F.log2(total / F.col("n_entity"))))
    flagged = cut(told.groupBy("term", "elsewhere").agg(F.max(F.col("n_both") >= F.col("n_term")).alias("certain")), "disclosing")
    # most flagged terms are in documents with an entity alone; only the rest is looked for elsewhere
    here = said.select("seq", "term").join(_small(flagged.drop("elsewhere")), "term")
    there = _said(others, "seq").join(_small(flagged.where("elsewhere").drop("elsewhere")), "term")
    return cut(here.unionByName(there), "said")


def _placed(found: DataFrame, said: DataFrame) -> DataFrame:
    """(seq, terms): the spans of all occurrences of the disclosing terms in the texts."""
    of = said.groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct("term", "certain"))).alias("of"))
    # each unit is a word with what lies before it, so that positions are running sums
    units = F.regexp_extract_all("text", F.lit(_UNIT), F.lit(0))
    word = lambda u: F.regexp_replace(u, r"^\P{L}+", "")
    ends = found.select("seq", "text").join(of, "seq").select("seq", "of", F.posexplode(units).alias("at", "unit"))
    ends = ends.select("seq", "at", F.length("unit").alias("n"), F.length(word("unit")).alias("width"), F.element_at("of", F.lower(word("unit"))).alias("certain"))
    so_far = Window.partitionBy("seq").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    spans = ends.withColumn("end", F.sum("n").over(so_far).cast("int")).where("certain is not null")
    mark = F.struct((F.col("end") - F.col("width")).alias("start"), F.lit(len(KINDS)).alias("rank"), "end", F.when(F.col("certain"), "certain").otherwise("likely").alias("match"))
    return spans.groupBy("seq").agg(F.collect_list(mark).alias("terms"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """A row for each document: id, base and spans, arrays of (start, rank, end, match or certain); rank 4 is a disclosing term."""
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = cut(_base(plain.withColumn("seq", F.monotonically_increasing_id()), "text"), "spans")
    kept = ["seq", "id", "base", *(["text"] if keep_text else [])]
    out = found.select(*kept).join(_placed(found, _disclosing(found)), "seq", "left")
    free = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", free)))
    return out.select(*kept[1:], spans.alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sanitised): spans give way to their kind in angle brackets; terms to <term>, or to nothing where they are certain."""
    found = find(docs, id_col, text_col, keep_text=True)
    # of spans that overlap, the earlier and longer goes first; what begins inside it is left out
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,put:string>>").alias("out"))
    put = lambda s: F.when((s["rank"] == len(KINDS)) & (s["match"] == "certain"), "").otherwise(F.concat(F.lit("<"), _name(s["rank"]), F.lit(">")))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), put(s).alias("put")))).alias("out")))
    cuts = found.withColumn("cuts", F.aggregate("spans", start, step, lambda a: a["out"]))
    last = lambda i: F.coalesce(F.get("cuts", i - 1)["end"], F.lit(0))
    pieces = F.transform("cuts", lambda c, i: F.concat(F.substring(F.col("text"), last(i) + 1, c["start"] - last(i)), c["put"]))
    tail = F.substring(F.col("text"), last(F.size("cuts")) + 1, F.length("text"))
    return cuts.select(F.col("id").alias(id_col), F.concat(F.array_join(pieces, ""), tail).alias("sanitised"))
