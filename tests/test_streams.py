"""Streams fed file by file: a late row, per-tool rates, a lag per object."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming import jobs


def _fed(spark, folder, schema, files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        # the source takes files by age
        import time

        time.sleep(1.1 if i < len(files) - 1 else 0)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def _at(hour, minute=0):
    return dt.datetime(2024, 1, 1 + hour // 24, hour % 24, minute)


def test_rates_by_tool_and_late_rows(spark, tmp_path):
    schema = "id long, ts timestamp_ntz, tool string, status string"
    files = [
        [(1, _at(1), "sql", "OK"), (2, _at(2), "sql", "ERROR"), (3, _at(3), "chart", "OK")],
        [(4, _at(26), "sql", "OK"), (4, _at(26), "sql", "OK"), (5, _at(27), "chart", "ERROR")],
        [(10, _at(28), "sql", "OK")],  # Spark drops what is behind the watermark of the batch before
        [(6, _at(4), "sql", "ERROR"), (7, _at(5), "sql", "ERROR"), (8, _at(49), "sql", "OK")],  # 6 and 7 come a day late
        [(9, _at(80), "chart", "OK")],
    ]
    events = _fed(spark, str(tmp_path), schema, files)
    rates = jobs.stream_error_rate(events, F.col("status") == "ERROR", by=["tool"], unique=["id"])
    batches = jobs.run_counted(rates, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    late = {r.batch_id: (r.input_rows, r.late_rows) for r in batches.collect() if r.input_rows}
    assert [late[b] for b in sorted(late)] == [(3, 0), (3, 0), (1, 0), (3, 2), (1, 0)]
    got = {(r.window_start.day, r.tool): (r.total_requests, r.error_count, r.error_pct) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, "sql"): (2, 1, 50.0), (1, "chart"): (1, 0, 0.0), (2, "sql"): (2, 0, 0.0), (2, "chart"): (1, 1, 100.0), (3, "sql"): (1, 0, 0.0)}


def test_each_object_has_its_own_lag(spark, tmp_path):
    schema = "object_name string, ts timestamp_ntz"
    files = [
        [("fast", _at(0)), ("slow", _at(0)), ("plain", _at(0))],
        [("fast", _at(2)), ("slow", _at(2)), ("plain", _at(2))],
        [("fast", _at(9)), ("slow", _at(9)), ("other", _at(40))],
        [("end", _at(90))],
    ]
    lags = spark.createDataFrame([("fast", 3600), ("slow", 4 * 3600)], "object_name string, target_lag_seconds long")
    out = jobs.stream_freshness(_fed(spark, str(tmp_path), schema, files), "2 hours", 3, lags=lags)
    jobs.run_available(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = sorted((r.object_name, r.runs, (r.silent_from - r.first_seen).total_seconds() / 3600) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # three lags of silence: 3 hours for fast, 12 for slow, 6 where no lag is given
    assert got == [("fast", 1, 3.0), ("fast", 2, 5.0), ("other", 1, 6.0), ("plain", 2, 8.0), ("slow", 3, 21.0)]


def test_batches_rewrite_their_databases_only(spark, tmp_path):
    schema = "database_name string, schema_name string, table_name string, schema_hash string, seen int"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    classes = spark.createDataFrame([("C", "A.S.T1"), ("C", "B.S.T1")], "class_name string, source_table string")
    path = str(tmp_path / "table")
    write = jobs.catalog_delta_writer(spark, path, classes, newest="seen")
    assert jobs.catalog_table(spark, path) is None
    write(batch(("A", "S", "T1", "h1", 1), ("A", "S", "T2", "h1", 1), ("B", "S", "T1", "h1", 1), (None, "S", "T1", "h1", 1), ("", "S", "T1", "h1", 1)), 0)
    write(batch().limit(0), 1)
    second = batch(("A", "S", "T1", "h9", 1), ("A", "S", "T1", "h2", 2), ("A", "S", "T3", "h1", 1), ("", "S", "T1", "h1", 1))
    for _ in range(2):  # the batch runs again
        write(second, 2)
        got = {(r.database_name, r.table_name): (r.schema_hash, r.action) for r in jobs.catalog_table(spark, path).collect()}
        assert got == {("A", "T1"): ("h2", "update"), ("A", "T2"): ("h1", "keep"), ("A", "T3"): ("h1", "insert"), ("B", "T1"): ("h1", "keep"), (None, "T1"): ("h1", "keep"), ("", "T1"): ("h1", "keep")}
        drift = [(r.object_fqn, r.old_hash, r.new_hash) for r in spark.read.parquet(f"{path}/drift").collect()]
        assert drift == [("A.S.T1", "h1", "h2")]
    spark.createDataFrame([("B", "S", "T1", "lost", "update", "d" + "0" * 32)], "database_name string, schema_name string, table_name string, schema_hash string, action string, part string").write.partitionBy("part").parquet(f"{path}/data/version=000000000003")
    assert jobs.catalog_table(spark, path).count() == 6  # files without a manifest, as a lost batch leaves them
    assert {r.action for r in jobs.catalog_table(spark, path, before=1).collect()} == {"insert"}
