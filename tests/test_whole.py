"""Inputs beyond the limits that once were defaults: long texts, deep and rare paths, missing features."""

from pyspark.sql import functions as F

from tidemark.operators import drift, model, sqlmining
from tidemark.sources import runs


def test_long_questions_stay_apart(spark):
    rows = [("why " * 80 + end, "ERROR", "timeout") for end in ("a", "b", "b")]
    got = drift.unanswered_intents(spark.createDataFrame(rows, "question string, status string, error_message string")).collect()
    assert [(r.sample_question, r.occurrence_count, r.priority) for r in got] == [(rows[1][0], 2, "LOW"), (rows[0][0], 1, "LOW")]


def test_long_queries_are_patterns(spark):
    text = "SELECT " + ", ".join(f"column_{i}" for i in range(2000)) + " FROM t"
    log = spark.createDataFrame([("q", text, "u")], "query_id string, query_text string, user_name string").withColumn("start_time", F.lit("2001-08-01").cast("timestamp_ntz"))
    assert len(text) > 10_000
    assert [r.query_text for r in sqlmining.query_patterns(log, "2001-08-02 00:00:00").collect()] == [text]
    assert sqlmining.query_patterns(log, "2001-08-02 00:00:00", max_length=10_000).count() == 0


def test_deep_and_rare_paths(spark):
    texts = ['{"a":{"b":{"c":{"d":[{"e":1}]}}}}', '{"rare.key":{"x":true}}', "{broken", None, "7"] + ['{"k":1}'] * 30 + ['{"n%d":1}' % i for i in range(60)]
    got = {(r.path, r.value_type): (r.occurrences, r.depth) for r in runs.json_paths(spark.createDataFrame([(x,) for x in texts], "body string"), "body").collect()}
    assert got[".a.b.c.d[].e", "BIGINT"] == (1, 6) and got[".rare.key.x", "BOOLEAN"] == (1, 2) and got[".k", "BIGINT"] == (30, 1)
    assert sum(p.startswith(".n") for p, _ in got) == 60


def test_rows_without_features_are_scored(spark):
    rows = [(i, None if i % 5 == 0 else float("nan") if i % 7 == 0 else float(i), int(i % 5 == 0 or i % 7 == 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, x double, y int")
    scored = model.score(df, model.train(df, ["x"], "y", rounds=2)).collect()
    assert {r.id: r.predicted for r in scored} == {i: y for i, _, y in rows}
