"""Inputs that the registered tables avoid: headers, record files, look-alike rows, absent winners, long chains."""

import json

from pyspark.sql import functions as F

from tidemark.operators import closure, evals
from tidemark.sources import query_files, runs


def test_each_csv_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('SQL,Question\nselect 1,"one, two"\n')
    (tmp_path / "b.csv").write_text('Question,SQL\nwhat,"select\n2"\n')
    (tmp_path / "c.csv").write_text("id,Owner,SQL\n7,me,select 3\n8,you,\n")
    (tmp_path / "d.csv").write_text("id,Owner\n7,me\n")
    rows = query_files.read_query_csv(spark, str(tmp_path)).collect()
    assert {(r.sql, tuple(sorted(r.metadata.items()))) for r in rows} == {
        ("select 1", (("Question", "one, two"),)),
        ("select\n2", (("Question", "what"),)),
        ("select 3", (("Owner", "me"), ("id", "7"))),
    }
    assert [r["index"] for r in query_files.read_query_dir(spark, str(tmp_path)).orderBy("index").collect()] == [1, 2, 3]


def test_run_files_indented_or_by_line(spark, tmp_path):
    run = {"run_id": "r", "skill_name": "s", "end_epoch": 100.0}
    (tmp_path / "a.json").write_text(json.dumps(run | {"run_id": "a"}, indent=2))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(run | {"run_id": x}) for x in "bc"))
    (tmp_path / "d.json").write_text("{broken")
    assert {r.run_id for r in runs.read_completed_runs(spark, str(tmp_path), 100.0).collect()} == {"a", "b", "c"}


def test_rows_that_look_alike_differ(spark):
    pair = lambda *rows: spark.createDataFrame(list(rows), "x string, y string")
    assert runs.dataset_diff(pair(("a|b", "c")), pair(("a", "b|c"))).count() == 3
    assert runs.dataset_diff(pair(("~", "c")), pair((None, "c"))).count() == 3
    assert runs.dataset_diff(pair(("a", "c")).withColumn("z", F.lit(1)), pair(("a", "c"))).count() == 3
    assert runs.dataset_diff(pair(("a", None)), pair(("a", None))).count() == 1


def test_open_decisions_are_not_rejections(spark):
    tests = lambda *d: evals.accepted(spark.createDataFrame([(x,) for x in d], "decision string")).first()
    assert tests("ACCEPT", "UNKNOWN").is_accepted is None
    assert tests("REJECT", "UNKNOWN").is_accepted is False
    assert tests("ACCEPT", "ACCEPT").is_accepted is True


def test_long_chains(spark):
    nodes = spark.range(67).select(F.col("id").cast("string").alias("node"))
    edges = spark.range(1, 67).select(F.col("id").cast("string").alias("child"), (F.col("id") - 1).cast("string").alias("parent"))
    levels = {r.node: r.level for r in closure.load_order(nodes, edges).collect()}
    assert levels == {str(i): i for i in range(67)}
