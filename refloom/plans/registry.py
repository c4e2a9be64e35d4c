"""The registered queries and their SQL oracles.

Queries run the engine over files derived from the tables (``corpus``). As the
files are made from rows, most oracles work out what must be found from the
rows, without reading any file; the rest parse the same files in other ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions import grammar
from refloom.operators import extract, lines, resolve, scan, verify
from refloom.operators import render
from refloom.plans import corpus

FLAGSHIP = "verify_all"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# --- what the rows say ------------------------------------------------------

#: Facts about each made file: its lines and definitions.
_FACTS = """
docs AS (SELECT doc_id, lang, source, 'docs/' || lang || '/d' || doc_id || '.md' AS file, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS k FROM documents),
defs AS (
  SELECT 'DOC-' || doc_id AS anchor, file, 1 AS start_line, 14 + k AS end_line, 'markdown' AS language FROM docs
  UNION ALL SELECT 'Details', file, 11 + k, 14 + k, 'markdown' FROM docs
  UNION ALL SELECT 'Notes ' || (doc_id % 5), file, 13 + k, 14 + k, 'markdown' FROM docs
  UNION ALL SELECT 'Customer ' || c_custkey, 'features/c' || c_custkey || '.feature', 1, 8, 'gherkin' FROM customer
  UNION ALL SELECT 'Segment ' || c_mktsegment, 'features/c' || c_custkey || '.feature', 5, 6, 'gherkin' FROM customer
  UNION ALL SELECT 'Nation ' || c_nationkey, 'features/c' || c_custkey || '.feature', 7, 8, 'gherkin' FROM customer
  UNION ALL SELECT 'Part' || p_partkey, 'src/p' || p_partkey || '.py', 2, 7, 'python' FROM part
  UNION ALL SELECT 'price', 'src/p' || p_partkey || '.py', 6, 7, 'python' FROM part
  UNION ALL SELECT 'S' || s_suppkey, 'src/s' || s_suppkey || '.rs', 2, 2, 'rust' FROM supplier
  UNION ALL SELECT 'get_' || s_suppkey, 'src/s' || s_suppkey || '.rs', 4, 7, 'rust' FROM supplier),
marks AS (
  SELECT file, 4 + k AS line, 'DOC-' || ((doc_id * 7) % 1100) AS anchor FROM docs
  UNION ALL SELECT file, 4 + k, 'Details' FROM docs
  UNION ALL SELECT file, 5 + k, file || '#Details' FROM docs
  UNION ALL SELECT file, 6 + k, file FROM docs
  UNION ALL SELECT file, 12 + k, 'arr[' || doc_id || ']' FROM docs
  UNION ALL SELECT 'features/c' || c_custkey || '.feature', 6, 'Customer ' || c_custkey FROM customer
  UNION ALL SELECT 'src/p' || p_partkey || '.py', 1, 'Part' || p_partkey FROM part
  UNION ALL SELECT 'src/p' || p_partkey || '.py', 7, 'price' FROM part
  UNION ALL SELECT 'src/s' || s_suppkey || '.rs', 1, 'S' || s_suppkey FROM supplier),
mens AS (
  SELECT file, 4 + k AS line, 'docs/' || lang || '/d' || (doc_id + 1) || '.md' AS token, false AS line_ref FROM docs
  UNION ALL SELECT file, 6 + k, file, true FROM docs
  UNION ALL SELECT file, 12 + k, 'and/or', false FROM docs
  UNION ALL SELECT 'src/p' || p_partkey || '.py', 1, 'docs/en/d' || p_partkey || '.md', false FROM part
  UNION ALL SELECT 'src/s' || s_suppkey || '.rs', 5, 'src/s' || s_suppkey || '.rs', false FROM supplier
  UNION ALL SELECT 'src/s' || s_suppkey || '.rs', 5, 'src/none.rs', false FROM supplier),
paths AS (SELECT file AS path FROM docs UNION ALL SELECT 'features/c' || c_custkey || '.feature' FROM customer
  UNION ALL SELECT 'src/p' || p_partkey || '.py' FROM part UNION ALL SELECT 'src/s' || s_suppkey || '.rs' FROM supplier),
whole AS (SELECT anchor, count(*) AS n FROM defs GROUP BY anchor),
parted AS (SELECT file || '#' || anchor AS anchor, count(*) AS n FROM defs GROUP BY ALL),
judged AS (
  SELECT m.*, CASE WHEN NOT contains(m.anchor, '#') AND contains(m.anchor, '/') THEN 'path-only-marker'
      WHEN coalesce(w.n, p.n, 0) = 0 THEN 'dangling-marker' WHEN coalesce(w.n, p.n) > 1 THEN 'ambiguous-marker' END AS rule,
    coalesce(w.n, p.n, 0) AS n, '[[rr:' || replace(replace(m.anchor, '[', chr(92) || '['), ']', chr(92) || ']') || ']]' AS raw
  FROM marks m LEFT JOIN whole w ON m.anchor = w.anchor LEFT JOIN parted p ON m.anchor = p.anchor),
found AS (
  SELECT file, line, rule, CASE WHEN rule = 'ambiguous-marker' THEN raw || ' resolves to ' || n || ' definitions' ELSE raw END AS detail FROM judged WHERE rule IS NOT NULL
  UNION ALL SELECT file, 7 + k, 'malformed-marker', 'unterminated [[rr: marker' FROM docs
  UNION ALL SELECT file, line, 'path-line', token FROM mens WHERE line_ref
  UNION ALL SELECT file, line, 'stale-mention', token FROM mens WHERE NOT line_ref AND split_part(token, '/', 1) IN ('docs', 'src', 'features') AND token NOT IN (SELECT path FROM paths))
"""


def _facts(select: str) -> str:
    return f"WITH {_FACTS} {select}"


def _query(name: str, oracle: str | None = None):
    def add(run):
        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = oracle
        return run

    return add


def _files(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    return corpus.files(spark, sf, *kinds)


def _forward(spark: SparkSession, sf: str, *languages: str) -> DataFrame:
    return extract.anchors(_files(spark, sf), languages or None)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in shared scratch, for queries that read it more than once. Without the optional subpackage, as it is."""
    try:
        from refloom.llm.scratch import cut
    except ImportError:
        return df
    return cut(df, name)


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(_forward(spark, sf).repartition("file"), "definitions")


_SPOT = "anchor, file, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line"
for _name, _language in (("anchors_markdown", "markdown"), ("scenarios", "gherkin"), ("python_symbols", "python"), ("rust_symbols", "rust")):
    _query(_name, _facts(f"SELECT {_SPOT}, language FROM defs WHERE language = '{_language}'"))(lambda spark, sf, language=_language: _forward(spark, sf, language))
_query("anchors_all", _facts(f"SELECT {_SPOT}, language FROM defs"))(lambda spark, sf: _forward(spark, sf))


@_query("sections_nested", _facts("SELECT file, sum(end_line - start_line + 1)::BIGINT AS covered_lines, count(*) AS n_sections FROM defs WHERE language IN ('markdown', 'gherkin') GROUP BY file"))
def sections_nested(spark, sf):
    width = F.sum(F.col("end_line") - F.col("start_line") + 1)
    return _forward(spark, sf, "markdown", "gherkin").groupBy("file").agg(width.alias("covered_lines"), F.count(F.lit(1)).alias("n_sections"))


@_query("record_ids", _facts("SELECT anchor, file FROM defs WHERE starts_with(anchor, 'DOC-')"))
def record_ids(spark, sf):
    return _forward(spark, sf, "markdown").where(F.col("anchor").rlike(r"\A[A-Z][A-Z0-9]*-[0-9]+\z")).select("anchor", "file")


@_query("lines_per_file", f"SELECT path, (length(content) - length(replace(content, chr(10), '')))::BIGINT AS n_lines FROM ({corpus.sql()})")
def lines_per_file(spark, sf):
    return lines.lines(_files(spark, sf)).groupBy("path").agg(F.max("line").alias("n_lines"))


@_query("canonical_order", _facts("SELECT anchor, file || ':' || start_line || '-' || end_line AS location, row_number() OVER (ORDER BY anchor, file || ':' || start_line || '-' || end_line)::BIGINT AS position FROM defs"))
def canonical_order(spark, sf):
    """The index's order, numbered."""
    return resolve.ordered(_stored(resolve.places(_forward(spark, sf)).repartition("location"), "places"))


@_query("anchor_multiplicity", _facts("SELECT anchor, count(*) AS n FROM defs GROUP BY anchor HAVING count(*) > 1"))
def anchor_multiplicity(spark, sf):
    return resolve.counts(_forward(spark, sf)).where("n > 1")


@_query("index_summary", _facts("SELECT (SELECT count(*) FROM defs) AS anchors, (SELECT count(*) FROM mens) AS mentions, (SELECT count(*) FROM docs) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS files"))
def index_summary(spark, sf):
    files = _files(spark, sf)
    parts = {"anchors": extract.anchors(files), "mentions": scan.mention_table(files), "files": files}
    counted = None
    for name, df in parts.items():
        own = df.agg(*[(F.count(F.lit(1)) if n == name else F.lit(0).cast("bigint")).alias(n) for n in parts])
        counted = own if counted is None else counted.unionByName(own)
    return counted.agg(*[F.sum(n).alias(n) for n in parts])


def _read(name: str, ref: str, where: str) -> None:
    @_query(name, _facts(f"SELECT '{ref}' AS ref, {_SPOT} FROM defs WHERE {where}"))
    def read(spark, sf):
        asked = spark.createDataFrame([(ref,)], "ref string")
        return resolve.resolve(asked, _forward(spark, sf)).where("anchor is not null")


_read("read_unique", "DOC-5", "anchor = 'DOC-5'")
_read("read_ambiguous", "Notes 3", "anchor = 'Notes 3'")
_read("read_qualified", "src/p7.py#price", "anchor = 'price' AND file = 'src/p7.py'")


@_query("resolve_batch", _facts("SELECT m.file, m.line::BIGINT AS line, m.anchor AS ref, coalesce(w.n, p.n, 0)::BIGINT AS n_defs FROM marks m LEFT JOIN whole w ON m.anchor = w.anchor LEFT JOIN parted p ON m.anchor = p.anchor"))
def resolve_batch(spark, sf):
    files = _files(spark, sf)
    refs = scan.hits(files, corpus.SCAN).where("hit = 'marker'").select("file", "line", F.col("anchor").alias("ref"))
    return resolve.count_definitions(refs, extract.anchors(files), "ref")


@_query("prefix_complete", _facts("SELECT DISTINCT anchor FROM defs WHERE starts_with(anchor, 'DOC-1')"))
def prefix_complete(spark, sf):
    return resolve.with_prefix(_forward(spark, sf), "DOC-1")


_POSITIONS = "(SELECT file, 12 + k AS line FROM docs UNION ALL SELECT file, 14 + k FROM docs UNION ALL SELECT file, 2 FROM docs UNION ALL SELECT 'src/p' || p_partkey || '.py', 7 FROM part UNION ALL SELECT 'features/c' || c_custkey || '.feature', 6 FROM customer UNION ALL SELECT 'src/s' || s_suppkey || '.rs', 5 FROM supplier)"


def _positions(spark, sf):
    total = F.size(lines.line_array(F.col("content"))).cast("bigint")
    md = _files(spark, sf, "md")
    at = lambda df, *xs: df.select(F.col("path").alias("file"), F.explode(F.array(*xs)).alias("line"))
    one = lambda kind, line: at(_files(spark, sf, kind), F.lit(line).cast("bigint"))
    return at(md, total - 2, total, F.lit(2).cast("bigint")).unionByName(one("py", 7)).unionByName(one("feature", 6)).unionByName(one("rs", 5))


_COVER = f"SELECT p.file, p.line, d.anchor, d.start_line, d.end_line FROM {_POSITIONS} p JOIN defs d ON p.file = d.file AND p.line BETWEEN d.start_line AND d.end_line"


@_query("covering_batch", _facts(f"SELECT file, line::BIGINT AS line, {_SPOT.replace(', file', '')} FROM ({_COVER})"))
def covering_batch(spark, sf):
    return resolve.covering(_positions(spark, sf), _forward(spark, sf))


@_query("at_all_nest", _facts(f"SELECT file, line::BIGINT AS line, anchor, row_number() OVER (PARTITION BY file, line ORDER BY end_line - start_line DESC, start_line, anchor)::INTEGER AS depth FROM ({_COVER})"))
def at_all_nest(spark, sf):
    return resolve.nest(_positions(spark, sf), _forward(spark, sf)).select("file", "line", "anchor", "depth")


@_query("at_innermost", _facts(f"SELECT file, line::BIGINT AS line, r.anchor, CASE WHEN n > 1 THEN file || '#' || r.anchor ELSE r.anchor END AS form, '[[rr:' || CASE WHEN n > 1 THEN file || '#' || r.anchor ELSE r.anchor END || ']]' AS marker FROM (SELECT *, rank() OVER (PARTITION BY file, line ORDER BY end_line - start_line, start_line DESC) AS r FROM ({_COVER})) r JOIN whole ON r.anchor = whole.anchor WHERE r = 1"))
def at_innermost(spark, sf):
    return resolve.locate(_positions(spark, sf), _index(spark, sf)).select("file", "line", "anchor", "form", "marker")


@_query("minimal_form", _facts("SELECT d.anchor, d.file, CASE WHEN n > 1 THEN d.file || '#' || d.anchor ELSE d.anchor END AS form FROM defs d JOIN whole USING (anchor)"))
def minimal_form(spark, sf):
    forward = _index(spark, sf)
    return forward.join(resolve.counts(forward), "anchor").select("anchor", "file", resolve.minimal_form(F.col("anchor"), F.col("file"), F.col("n")).alias("form"))


def _hits(spark, sf):
    return scan.hits(_files(spark, sf), corpus.SCAN)


_RAW = "'[[rr:' || replace(replace(anchor, '[', chr(92) || '['), ']', chr(92) || ']') || ']]'"
_query("markers_all", _facts(f"SELECT file, line::BIGINT AS line, {_RAW} AS raw, anchor FROM marks"))(lambda spark, sf: _hits(spark, sf).where("hit = 'marker'").select("file", "line", "raw", "anchor"))
_query("markers_filtered", _facts("SELECT file, line::BIGINT AS line, anchor FROM marks WHERE anchor = 'Details' OR ends_with(anchor, '#Details')"))(
    lambda spark, sf: _hits(spark, sf).where(F.col("hit") == "marker").where(resolve.search_filter(F.col("anchor"), "Details")).select("file", "line", "anchor")
)
_query("markers_escaped", _facts(f"SELECT file, {_RAW} AS raw, anchor FROM marks WHERE contains(anchor, '[')"))(
    lambda spark, sf: _hits(spark, sf).where("hit = 'marker' and contains(raw, '\\\\')").select("file", "raw", "anchor")
)
_query("comment_markers", _facts("SELECT file, line::BIGINT AS line, anchor FROM marks WHERE starts_with(file, 'src/')"))(
    lambda spark, sf: scan.hits(_files(spark, sf, "py", "rs"), corpus.SCAN).where("hit = 'marker'").select("file", "line", "anchor")
)


@_query("marker_roundtrip", "SELECT count(*) AS n, count(*) AS same FROM (SELECT DISTINCT p_name FROM part)")
def marker_roundtrip(spark, sf):
    names = spark.read.parquet(f"{sf}/part.parquet").select("p_name").distinct().select(F.concat(F.lit("[\\"), "p_name", F.lit("]]x")).alias("name"))
    back = grammar.name_of(grammar.wrap(F.col("name")))
    return names.agg(F.count(F.lit(1)).alias("n"), F.count_if((back == F.col("name")) & grammar.is_marker(grammar.wrap(F.col("name")))).alias("same"))


_query("malformed_openers", _facts("SELECT file, (7 + k)::BIGINT AS line FROM docs"))(lambda spark, sf: _hits(spark, sf).where("hit = 'malformed'").select("file", "line"))
_query("malformed_reasons", "SELECT 'unterminated [[rr: marker' AS reason, count(*) AS n FROM documents HAVING count(*) > 0")(lambda spark, sf: _hits(spark, sf).where("hit = 'malformed'").groupBy("reason").agg(F.count(F.lit(1)).alias("n")))
_query("mentions_all", _facts("SELECT file, line::BIGINT AS line, token, line_ref FROM mens"))(lambda spark, sf: _hits(spark, sf).where("hit = 'mention'").select("file", "line", "token", "line_ref"))
_query("mentions_line_ref", _facts("SELECT file, line::BIGINT AS line, token FROM mens WHERE line_ref"))(lambda spark, sf: _hits(spark, sf).where("hit = 'mention' and line_ref").select("file", "line", "token"))
_query("mentions_in_fence_hidden", "SELECT 0::BIGINT AS n_hidden")(lambda spark, sf: _hits(spark, sf).where("token = 'docs/hidden/x.md' or anchor = 'Hidden'").agg(F.count(F.lit(1)).alias("n_hidden")))
_query("fence_visible_lines", _facts("SELECT file AS path, (11 + k)::BIGINT AS n_visible FROM docs"))(lambda spark, sf: lines.visible_lines(_files(spark, sf, "md")).groupBy("path").agg(F.count(F.lit(1)).alias("n_visible")))


def _findings(spark, sf, rules=tuple(verify.RULES)):
    files = _files(spark, sf)
    return verify.findings(files, extract.anchors(files), verify.entries_of(files.select("path")), rules, corpus.SCAN).select("file", "line", "rule", "detail")


_FOUND = "SELECT file, line::BIGINT AS line, rule, detail FROM found"
_query("verify_all", _facts(_FOUND))(_findings)
for _rule in verify.RULES:
    _query(f"verify_{_rule.replace('-', '_')}", _facts(f"{_FOUND} WHERE rule = '{_rule}'"))(lambda spark, sf, rule=_rule: _findings(spark, sf, (rule,)))
_query("verify_rule_subset", _facts(f"{_FOUND} WHERE rule IN ('dangling-marker', 'stale-mention')"))(lambda spark, sf: _findings(spark, sf, ("dangling-marker", "stale-mention")))
_query("verify_counts", _facts("SELECT rule, count(*) AS n FROM found GROUP BY rule"))(lambda spark, sf: _findings(spark, sf).groupBy("rule").agg(F.count(F.lit(1)).alias("n")))


@_query("scope_filter", _facts("SELECT path FROM paths WHERE ends_with(path, '.md') AND NOT starts_with(path, 'docs/de/')"))
def scope_filter(spark, sf):
    from refloom.sources.globs import in_scope

    return _files(spark, sf).select("path").where(in_scope(F.col("path"), ["**/*.md"], ["docs/de/**"]))


@_query("entries", _facts("SELECT path, false AS is_dir FROM paths UNION ALL SELECT DISTINCT 'docs/' || lang, true FROM docs UNION ALL SELECT DISTINCT split_part(path, '/', 1), true FROM paths"))
def entries(spark, sf):
    return verify.entries_of(_files(spark, sf).select("path"))


@_query("freshness_max", "SELECT max(epoch(ts)::BIGINT) AS newest FROM events")
def freshness_max(spark, sf):
    """To the nearest second, halves to the even one. The time bears no zone, so the session's doesn't count."""
    last = spark.read.parquet(f"{sf}/events.parquet").agg(F.max("ts").cast("timestamp_ntz").cast("string").alias("ts"))
    micros = F.unix_micros(F.concat("ts", F.lit("Z")).cast("timestamp"))
    return last.select(F.rint(micros / F.lit(1e6)).cast("bigint").alias("newest"))


@_query("path_shapes", "SELECT url AS token, false AS is_path FROM pages UNION ALL SELECT split_part(url, '://', 2), NOT regexp_matches(split_part(url, '://', 2), '(^|/)(/|$)') AND contains(split_part(url, '://', 2), '/') FROM pages")
def path_shapes(spark, sf):
    urls = spark.read.parquet(f"{sf}/pages.parquet")
    tokens = urls.select(F.explode(F.array("url", F.split_part("url", F.lit("://"), F.lit(2)))).alias("token"))
    return tokens.select("token", grammar.is_path(F.col("token")).alias("is_path"))


@_query("locations_parsed", _facts("SELECT file || ':' || start_line || '-' || end_line AS location, file, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line FROM defs"))
def locations_parsed(spark, sf):
    spot = grammar.location(F.col("file"), F.col("start_line"), F.col("end_line"))
    return _forward(spark, sf).select(spot.alias("location")).select("location", grammar.parse_location(F.col("location")).alias("p")).select("location", "p.*")


_ENTRY = "'{\"file\":\"' || file || '\",\"line\":' || line || ',\"rule\":\"stale path mention\"}'"
_query("json_envelope", _facts(f"SELECT '{{\"format\":\"rr-json\",\"version\":1,\"command\":\"verify\",\"data\":{{\"findings\":[' || coalesce(string_agg({_ENTRY}, ',' ORDER BY file, line), '') || ']}}}}' AS json FROM found WHERE rule = 'stale-mention'"))(
    lambda spark, sf: render.verify_document(_stale(spark, sf))
)


def _stale(spark, sf):
    files = _files(spark, sf)
    return verify.findings(files, extract.anchors(files), verify.entries_of(files.select("path")), ("stale-mention",), corpus.SCAN)
