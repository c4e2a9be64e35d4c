"""A corpus of files derived from the driver's tables, in SQL that both engines read.

Markdown from documents, Gherkin from customers, Python from parts and Rust from
suppliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of (table, id column, path, lines). A line is a SQL expression.
_MD = ("documents", "'docs/' || lang || '/d' || doc_id || '.md'", [
    "'# DOC-' || doc_id || ': ' || source", "''", "coalesce(text, '')", "''",
    "'See [[rr:DOC-' || ((doc_id * 7) % 1100) || ']] and [[rr:Details]] in docs/' || lang || '/d' || (doc_id + 1) || '.md for more.'",
    "'Span `[[rr:docs/' || lang || '/d' || doc_id || '.md#Details]]` and `docs/none/x.md` here.'",
    "'Path [[rr:docs/' || lang || '/d' || doc_id || '.md]] at docs/' || lang || '/d' || doc_id || '.md:7 end.'",
    "'Bad [[rr:oops never closed docs/' || lang || '/gone.md'",
    "'```'", "'[[rr:Hidden]] docs/hidden/x.md'", "'```'",
    "'## Details'", "'Escaped [[rr:arr{b}[' || doc_id || '{b}]]] done, and/or not.'", "'### Notes ' || (doc_id % 5)", "'tail'",
])
_FEATURE = ("customer", "'features/c' || c_custkey || '.feature'", [
    "'Feature: Customer ' || c_custkey", "'  \"\"\"'", "'  Scenario: hidden'", "'  \"\"\"'", "'  Scenario: Segment ' || c_mktsegment",
    "'    Given [[rr:Customer ' || c_custkey || ']]'", "'  Scenario: Nation ' || c_nationkey", "'    Then done'",
])
_PY = ("part", "'src/p' || p_partkey || '.py'", [
    "'# See docs/en/d' || p_partkey || '.md and [[rr:Part' || p_partkey || ']]'", "'class Part' || p_partkey || ':'", "'    \"\"\"Doc # [[rr:hidden]]\"\"\"'",
    "'    size = ' || p_size", "''", "'    def price(self):'", "'        return \"[[rr:string]]\"  # [[rr:price]]'",
])
_RS = ("supplier", "'src/s' || s_suppkey || '.rs'", [
    "'//! Supplier [[rr:S' || s_suppkey || ']]'", "'pub struct S' || s_suppkey || ';'", "''", "'fn get_' || s_suppkey || '<{q}a>(x: &{q}a str) -> &{q}a str {'",
    "'    let u = \"http://x\"; // see src/s' || s_suppkey || '.rs and src/none.rs'", "'    x'", "'}'",
])
KINDS = {"md": _MD, "feature": _FEATURE, "py": _PY, "rs": _RS}
#: The column that tells a table's rows apart, and the tasks a core that its rows are dealt out to.
KEYS = {"md": "doc_id", "feature": "c_custkey", "py": "p_partkey", "rs": "s_suppkey"}
SPREAD = 3
SCAN = {"python": ["comments"], "rust": ["comments"]}


def _columns(kind: str) -> tuple[str, str]:
    """SQL of path and content; characters that the engines quote differently are given by number."""
    _, path, rows = KINDS[kind]
    content = " || chr(10) || ".join(rows) + " || chr(10)"
    return path, content.replace("{b}", "' || chr(92) || '").replace("{q}", "' || chr(39) || '")


def sql(*kinds: str) -> str:
    """SELECT path, content of the given kinds of files, for either engine."""
    return " UNION ALL ".join("SELECT {} AS path, {} AS content FROM {}".format(*_columns(k), KINDS[k][0]) for k in kinds or KINDS)


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows over all cores, where the table lies in fewer files than there are cores: a few MB of keys make a million files."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= cores else rows.repartition(SPREAD * cores, key)


def files(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """(path, content, extension) of the given kinds of files, or of all. A kind is its files' extension."""
    out = None
    for kind in kinds or KINDS:
        path, content = _columns(kind)
        table, key = KINDS[kind][0], KEYS[kind]
        part = _dealt(spark.read.parquet(f"{sf_dir}/{table}.parquet"), key).selectExpr(f"{path} AS path", f"{content} AS content", f"'{kind}' AS extension")
        out = part if out is None else out.unionByName(part)
    return out
