"""Parts of results that are rows of their own: specifications, documents, spans, positions, matched issues."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.exact import merged_spans, numbered_in_order
from tidemark.operators import catalog as K
from tidemark.operators import evals as E
from tidemark.operators import questions as Q
from tidemark.operators import retrieval as S
from tidemark.operators import reviews as V
from tidemark.operators import sqlmining as X
from tidemark.operators import trends as B
from tidemark.operators import usage as U
from tidemark.sources import query_files as Z


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_positions_of_a_hot_group_with_ties_and_nulls(spark):
    rows = [("a" if i % 10 else "b", None if i % 7 == 0 else float(i % 5), f"n{i:04d}") for i in range(3000)] + [(None, 1.0, "x")]
    df = spark.createDataFrame(rows, "k string, v double, name string").repartition(7)
    got = numbered_in_order(df, ["k"], [F.desc_nulls_last("v"), F.asc("name")]).collect()
    expect = {}
    for k in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        expect.update({(k, r[2]): i for i, r in enumerate(own, 1)})
    assert {(r.k, r.name): r.position for r in got} == expect


def test_all_names_of_a_risk_unless_a_number_is_given(spark):
    rows = [("OPEN", "HIGH", f"n{i}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "status string, risk string, name string, item_value double")
    assert B.risk_items(df).count() == 60
    assert [r.name for r in B.risk_items(df, 2).orderBy("position").collect()] == ["n59", "n58"]
    assert B.risk_items(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merged_spans_cover_the_same_times(spark, seed):
    begins = [(i * 37 * seed) % 500 for i in range(40)]
    spans = [(at(s), at(s + (i * 11 * seed) % 130)) for i, s in enumerate(begins)] + [(None, at(3)), (at(5), None), (at(9), at(4))]
    df = spark.createDataFrame(spans, "s timestamp_ntz, e timestamp_ntz")
    merged = [(r.s, r.e) for r in merged_spans(df, "s", "e").collect()]
    full = [(s, e) for s, e in spans if s and e and s <= e]
    for m in range(0, 700):
        t = at(m) + dt.timedelta(seconds=30 * (m % 2))
        assert any(s <= t <= e for s, e in full) == any(s <= t <= e for s, e in merged), t
    by_hour = {}
    for s, e in merged:
        by_hour.setdefault(s.replace(minute=0, second=0), []).append((s, e))
    for own in by_hour.values():
        own.sort()
        assert all(a[1] < b[0] for a, b in zip(own, own[1:]))


def test_ten_thousand_windows_are_a_few_spans(spark):
    i = F.col("id").cast("int")
    begin = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(i % 5000).cast("decimal(18,6)"))
    windows = spark.range(10_000).select(begin.alias("start_ts"), (begin + F.expr("INTERVAL 3 HOUR")).alias("end_ts"))
    assert merged_spans(windows, "start_ts", "end_ts").count() == 5
    joined = spark.createDataFrame([(1, True, "m", None, "U1", at(30), "q", "R"), (2, True, "m", None, "U1", at(600), "q", "R")], "request_id long, is_positive boolean, feedback_message string, categories string, user_name string, ts timestamp_ntz, input_query string, request_user string")
    known = spark.createDataFrame([("other",)], "input_query string")
    assert [r.request_id for r in E.feedback_candidates(joined, known, windows).collect()] == [2]


def test_specification_rows(spark):
    columns = spark.createDataFrame([("SALES", "S_DB", "CORE", "ORDERS"), ("SALES", "S_DB", "CORE", "ORDERS"), ("SALES", "S_DB", "RAW", "ITEMS"), ("OPS", "O_DB", "CORE", "ORDERS")], "domain string, database_name string, schema_name string, table_name string")
    metrics = spark.createDataFrame([("SALES", "sum_Orders_orders", "SUM(x)", "how many?"), ("SALES", "avg", "AVG(y)", None), ("X", "sum_orders", "SUM(z)", None), ("SALES", None, "N", None)], "domain string, metric_name string, expr string, sample_questions string")
    got = [tuple(r) for r in Q.spec_metrics(columns, metrics).collect()]
    assert got == [("sv_sales", "S_DB.CORE.ORDERS", "orders", "sum_Orders_orders", "SUM(x)", "how many?")]
    assert Q.spec_metrics(columns.limit(0), metrics).count() == 0
    links = spark.createDataFrame([("a_to_b", "S_DB", "a", "b", "ID"), ("c_to_d", "NONE", "c", "d", "ID")], "name string, database_name string, left_table string, right_table string, relationship_columns string")
    assert [(r.name, r.relation) for r in Q.spec_relations(columns, links).collect()] == [("sv_sales", "a_to_b")]
    asked = spark.createDataFrame([("SALES", "v1", "q", "select 1", True), ("X", "v2", "q", "select 2", False)], "domain string, name string, question string, sql string, use_as_onboarding_question boolean")
    assert [(r.name, r.query_name) for r in Q.spec_verified(columns, asked).collect()] == [("sv_sales", "v1")]


def test_written_run_holds_summary_queries_and_groups(spark, tmp_path):
    log = spark.createDataFrame([(1, "D", "q", "SELECT 1 FROM A.B.DIM_X"), (2, "E", "q", "SELECT 1 FROM A.B.DIM_X JOIN A.B.FCT_Y ON 1"), (250_000, "", "q", "SELECT 1 FROM A.B.DIM_X"), (4, "D", "q", "DELETE FROM A.B.Z")], "query_id long, domain string, question string, query_text string")
    done = X.process_queries(log)
    Z.write_extraction(done, X.extraction_summary(done), X.table_usage(done), str(tmp_path / "run"))
    lines = lambda part: [json.loads(x) for f in (tmp_path / "run" / part).glob("*.json") for x in f.read_text().splitlines()]
    (total,) = lines("summary")
    assert total["summary"]["processed"] == 3 and total["summary"]["skipped"] == 1
    assert len(lines("queries")) == 4
    found = {(x["group"], x["table"], x["block"]): x["used_in_queries"] for x in lines("consolidated")}
    assert found == {("dimension_tables", "A.B.DIM_X", 0): [1, 2], ("dimension_tables", "A.B.DIM_X", 2): [250_000], ("fact_tables", "A.B.FCT_Y", 0): [2]}
    assert {(r.domain, r.table_name): r.query_count for r in X.domain_tables(done).collect()} == {("D", "A.B.DIM_X"): 1, ("E", "A.B.DIM_X"): 1, ("E", "A.B.FCT_Y"): 1, ("Unknown", "A.B.DIM_X"): 1}
    assert sorted(r.query_index for r in X.shared_table_queries(done).collect()) == [1, 2, 250_000]


def test_relations_inside_a_question_by_confidence(spark):
    hits = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "a"), (2, "a")], "question_id long, full_name string")
    links = spark.createDataFrame([("a", "x", "b", "id", 0.5), ("c", "y", "a", "id", 0.9), ("a", "z", "d", "id", 1.0)], "source_table string, source_column string, target_table string, target_column string, confidence double")
    got = [(r.question_id, r.position, r.source_table, r.target_table) for r in S.internal_relations(hits, links).orderBy("position").collect()]
    assert got == [(1, 1, "c", "a"), (1, 2, "a", "b")]


def test_relations_inside_a_question_keep_their_kind(spark):
    """Two kinds of relation between two tables came out as rows that could not be told apart, in any order."""
    hits = spark.createDataFrame([(1, "a"), (1, "b")], "question_id long, full_name string")
    rows = [("a", "x", "b", "id", "ONTOLOGY", 1.0, True), ("a", "x", "b", "id", "FK", 1.0, True), ("a", "y", "b", "id", "FK", 1.0, False), ("b", "z", "a", "id", "FK", 1.0, None)]
    links = spark.createDataFrame(rows, "source_table string, source_column string, target_table string, target_column string, relationship_type string, confidence double, is_active boolean")
    got = [(r.position, r.source_column, r.relationship_type) for r in S.internal_relations(hits, links).orderBy("position").collect()]
    assert got == [(1, "x", "FK"), (2, "x", "ONTOLOGY")]


def test_issues_meet_by_id_then_line_then_text(spark):
    schema = "plan_id long, issue_id long, line long, description string"
    base = spark.createDataFrame([(1, 1, 10, "a"), (1, 2, 20, "b"), (1, 3, 30, "c"), (1, 4, 40, "d")], schema)
    current = spark.createDataFrame([(1, 1, 99, "z"), (1, 12, 20, "reworded"), (1, 13, 35, "c"), (1, 14, 77, "new")], schema)
    got = {(r.issue_id, r.status) for r in V.delta_review(base, current).collect()}
    assert got == {(1, "OPEN"), (2, "OPEN"), (3, "OPEN"), (4, "FIXED"), (14, "NEW")}


def test_change_per_dimension_and_in_total(spark):
    schema = "plan_id long, dimension string, points long"
    got = {(r.dimension): (r.baseline, r.current, r.change) for r in V.dimension_delta(spark.createDataFrame([(1, "scope", 6), (1, "risk", None)], schema), spark.createDataFrame([(1, "scope", 8), (1, "context", 3)], schema)).collect()}
    assert got == {"scope": (6, 8, 2), "risk": (None, None, None), "context": (None, 3, None), "TOTAL": (6, 11, 5)}


def test_settings_of_a_domain(spark):
    schema = "domain string, key string, value string"
    config = spark.createDataFrame([("A", "enrichment_max_tier", "1"), ("B", "k", "v")], schema)
    overrides = spark.createDataFrame([("A", "enrichment_max_tier", "3"), ("C", "enrichment_max_tier", "2")], schema)
    sources = spark.createDataFrame([("A", "D1"), ("A", "D2"), ("A", "D2"), ("B", "D3")], "domain string, database_name string")
    got = {r.domain: (r.database_count, r.tier, r.changed_settings) for r in K.config_summary(K.upsert_config(config, overrides, sources.select("domain")), sources).collect()}
    assert got == {"A": (2, "3", 1), "B": (1, "0", 0)}


def test_each_name_of_a_text_counts_once(spark):
    history = spark.createDataFrame([("A", "B", t, "ID", 1) for t in ("X", "Y", "Z")], "database_name string, schema_name string, table_name string, column_name string, ds int")
    log = spark.createDataFrame([("select 1 from a.b.x join A.B.Y on 1 join a.b.x z on 1", "2024-01-01 00:00:00"), (None, "2024-01-01 00:00:00")], "query_text string, start_time string").withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))
    assert {r.table_name: r.mention_count for r in U.latest_columns(history, log, "2024-01-02 00:00:00").collect()} == {"X": 1, "Y": 1, "Z": 0}
