"""Registered queries against their SQL where the given tables don't tell right from wrong."""

import bisect

import duckdb
import pytest
from pyspark.sql import functions as F

from refloom.operators import resolve
from refloom.plans import corpus, registry


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_newest_event_is_rounded(spark, tmp_path, zone):
    """SQL rounds an epoch to the nearest second, halves to the even one."""
    con = duckdb.connect()
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for i, newest in enumerate(["2024-03-10 02:30:01.7", "2024-03-10 02:30:01.2", "2024-01-01 00:00:00.5", "2024-01-01 00:00:01.5", "1969-12-31 23:59:57.5", "1900-01-01 00:00:00.9"]):
            sf = tmp_path / str(i)
            sf.mkdir()
            con.sql(f"SELECT TIMESTAMP '{newest}' AS ts UNION ALL SELECT TIMESTAMP '1800-05-05 05:05:05.9' UNION ALL SELECT NULL").write_parquet(f"{sf}/events.parquet")
            con.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
            want = con.sql(registry.ORACLE_SQL["freshness_max"]).fetchall()[0][0]
            assert registry.QUERIES["freshness_max"](spark, str(sf)).first()["newest"] == want, newest
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


SF = "/root/testdata/sf0.001"


def reads(df):
    """How many tables the plan reads, and how many times it starts Python."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation ["), plan.count("MapInPandas")


@pytest.mark.parametrize("name", ["locations_parsed", "prefix_complete", "anchor_multiplicity"])
def test_extraction_reads_each_table_once(spark, name):
    """No second pass for the lengths of files, and no language on other languages' files."""
    assert reads(registry.QUERIES[name](spark, SF)) == (4, 2)


def test_positions_are_covered_in_one_pass_more(spark):
    for name in ("covering_batch", "at_all_nest"):
        assert reads(registry.QUERIES[name](spark, SF)) == (8, 2), name


def test_small_tables_are_dealt_out(spark):
    for kind in corpus.KINDS:
        tasks = corpus.files(spark, SF, kind).select(F.spark_partition_id()).distinct().count()
        assert tasks >= min(4, spark.sparkContext.defaultParallelism), kind


def test_ranges_are_found_by_few_comparisons(spark):
    """Against bisection, for any number of bounds."""
    rows = [(f"n{i % 7}", f"f{i}:1-2") for i in range(60)]
    for n in (0, 1, 2, 3, 10, 37):
        bounds = sorted(rows[::2])[:n]
        got = spark.createDataFrame(rows, "anchor string, location string").withColumn("r", resolve._range(bounds)).collect()
        assert all(r.r == bisect.bisect_right(bounds, (r.anchor, r.location)) for r in got), n


@pytest.mark.parametrize(("name", "most"), [("canonical_order", 0), ("minimal_form", 0), ("read_unique", 4), ("read_ambiguous", 4), ("read_qualified", 4), ("resolve_batch", 8), ("index_summary", 12)])
def test_definitions_are_extracted_once(spark, name, most):
    """A plan reads each table at most once for definitions, once for hits and once for paths; no table, if they are stored."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") - plan.count("Relation [anchor") <= most


def test_qualified_names(spark):
    """A whole name with # comes before the name in a file; a name of many files is looked up once."""
    forward = spark.createDataFrame([("a#b", "x", 1, 1), ("b", "a", 2, 2), ("b", "c", 3, 3), ("b", "c", 4, 4), ("#", "d#e", 5, 5), ("n", "d#e", 6, 6)], "anchor string, file string, start_line long, end_line long")
    want = {"a#b": [1], "b": [2, 3, 4], "c#b": [3, 4], "#": [5], "d#e#n": [], "d#": [], "#b": [], "none": [], None: []}
    refs = spark.createDataFrame([(r,) for r in want], "ref string")
    got = resolve.resolve(refs, forward).collect()
    assert {r: sorted(x.start_line for x in got if x.ref == r and x.anchor) for r in want} == want
    assert {r.ref: r.n_defs for r in resolve.count_definitions(refs, forward, "ref").collect()} == {r: None if r is None else len(v) for r, v in want.items()}


@pytest.mark.parametrize(("rule", "most"), [("malformed_marker", (4, 2)), ("path_only_marker", (4, 2)), ("dangling_marker", (8, 4)), ("ambiguous_marker", (8, 4)), ("rule_subset", (20, 4)), ("counts", (20, 4)), ("all", (20, 4))])
def test_gate_scans_once_and_reads_what_its_rules_need(spark, rule, most):
    """Hits once; definitions only to count them; paths (files, their folders, and the top folders) only for mentions."""
    got = reads(registry.QUERIES[f"verify_{rule}"](spark, SF))
    assert got[0] <= most[0] and got[1] <= most[1], got
