"""Streaming and model queries. Each stream reads its input table as files and runs to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import catalog as K
from tidemark.operators import model as M
from tidemark.plans.inputs import Inputs
from tidemark.plans.q_catalog import classes_of, hash_sql
from tidemark.plans.q_knowledge import triage_objects
from tidemark.plans.registry import QUERIES, query
from tidemark.session import scratch_folder
from tidemark.streaming import jobs as W


def replay(t, df, files: int = 4):
    """A DataFrame written as files and read back as a stream, in order of its time column."""
    folder = scratch_folder(t.spark)
    df.write.parquet(folder)
    return t.spark.readStream.schema(df.schema).parquet(folder)


def finished(t, stream):
    """Result of a stream after all its input."""
    root = scratch_folder(t.spark)
    W.run_available(stream, f"{root}/out", f"{root}/checkpoint")
    return t.spark.read.schema(stream.schema).parquet(f"{root}/out")


class StreamInputs(Inputs):
    """Input relations over the driver tables read as streams."""

    def table(self, name: str):
        # a stream is read as its files arrive, so it is not spread
        schema = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)

    def _spread(self, df):
        return df


def live(t):
    return StreamInputs(t.spark, t.sf_dir)


def utc(c: str):
    """Stream times as zoneless times again, for the comparison."""
    return F.col(c).cast("timestamp_ntz")


@query(
    "stream_failures",
    "SELECT DISTINCT object_name, object_type, ts, message FROM run_history WHERE state = 'FAILED'",
    ("run_history",),
)
def _(t):
    return finished(t, W.stream_failures(live(t).run_history)).withColumn("ts", utc("ts"))


@query(
    "stream_cost_window",
    """SELECT date_trunc('hour', created_at) AS hour_window, count(*) AS model_calls FROM audit_log WHERE action_type IN ('DIAGNOSE', 'DIAGNOSE_DT') AND model_used <> 'RUNBOOK' GROUP BY 1
       HAVING count(*) > 1 AND date_trunc('hour', created_at) + INTERVAL 1 HOUR <= (SELECT max(created_at) - INTERVAL 1 HOUR FROM audit_log WHERE action_type IN ('DIAGNOSE', 'DIAGNOSE_DT') AND model_used <> 'RUNBOOK')""",
    ("audit_log",),
)
def _(t):
    return finished(t, W.stream_cost_window(live(t).audit_log, 1)).withColumn("hour_window", utc("hour_window"))


@query(
    "stream_breaker",
    """WITH g AS (SELECT time_bucket(INTERVAL 5 MINUTE, detected_at) + to_minutes(CAST(5 * (i + 1) AS INT)) AS window_end, detected_at, status, fix_attempts FROM failures, range(24) r(i)),
    a AS (SELECT window_end, count(*) FILTER (status = 'ESCALATED' AND detected_at >= window_end - INTERVAL 1 HOUR) AS recent_escalations, count(*) FILTER (fix_attempts >= 3 AND status <> 'RESOLVED') AS recent_fix_loops FROM g GROUP BY 1)
    SELECT * FROM a WHERE (recent_escalations > 2 OR recent_fix_loops > 2) AND window_end <= (SELECT max(detected_at) - INTERVAL 1 HOUR FROM failures)""",
    ("failures",),
)
def _(t):
    return finished(t, W.stream_breaker(live(t).failures, threshold=2, loops=2)).withColumn("window_end", utc("window_end"))


@query(
    "stream_freshness",
    """WITH o AS (SELECT object_name, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 24 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM run_history WINDOW w AS (PARTITION BY object_name ORDER BY ts)),
    s AS (SELECT object_name, ts, sum(new) OVER (PARTITION BY object_name ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o),
    g AS (SELECT object_name, count(*) AS runs, min(ts) AS first_seen, max(ts) + INTERVAL 24 HOUR AS silent_from FROM s GROUP BY object_name, k)
    SELECT * FROM g WHERE silent_from <= (SELECT max(ts) - INTERVAL 1 HOUR FROM run_history)""",
    ("run_history",),
)
def _(t):
    return finished(t, W.stream_freshness(live(t).run_history)).withColumns({"first_seen": utc("first_seen"), "silent_from": utc("silent_from")})


@query(
    "stream_run_pairs",
    """WITH st AS (SELECT run_id, started AS start_ts, duration_seconds AS d, user_id FROM timing_runs),
    en AS (SELECT run_id, start_ts + to_microseconds(CAST(round(d * 1000000) AS BIGINT)) AS end_ts FROM st WHERE user_id % 9 <> 0)
    SELECT run_id, start_ts, end_ts, CASE WHEN end_ts IS NULL THEN 'open' ELSE 'completed' END AS status FROM st LEFT JOIN en USING (run_id)
    WHERE end_ts IS NOT NULL OR start_ts + INTERVAL 24 HOUR < (SELECT least((SELECT max(start_ts) FROM st), (SELECT max(end_ts) FROM en)) - INTERVAL 1 HOUR)""",
    ("timing_runs",),
)
def _(t):
    runs = live(t).timing_runs
    at = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round("duration_seconds", 6).cast("decimal(18,6)"))
    starts = runs.select("run_id", F.col("started").alias("start_ts"))
    ends = live(t).timing_runs.filter("user_id % 9 <> 0").select("run_id", (F.col("started") + at).alias("end_ts"))
    return finished(t, W.stream_run_pairs(starts, ends)).withColumns({"start_ts": utc("start_ts"), "end_ts": utc("end_ts")})


@query(
    "stream_error_rate",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS total_requests, count(*) FILTER (event_type = 'error') AS error_count FROM events GROUP BY date_trunc('day', ts)
       HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(e.ts) - INTERVAL 1 HOUR FROM events e)""",
)
def _(t):
    return finished(t, W.stream_error_rate(live(t).table("events"), F.col("event_type") == "error")).withColumn("window_start", utc("window_start"))


@query(
    "stream_tool_error_rate",
    """WITH e AS (SELECT ts, event_type, CASE (user_id + event_id) % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'search' ELSE 'chart' END AS tool_name FROM events)
    SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, tool_name, count(*) AS total_requests, count(*) FILTER (event_type = 'error') AS error_count,
      round(count(*) FILTER (event_type = 'error') * 100.0::DOUBLE / count(*), 1) AS error_pct FROM e GROUP BY date_trunc('day', ts), tool_name
    HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(x.ts) - INTERVAL 1 HOUR FROM events x)""",
)
def _(t):
    k = (F.col("user_id") + F.col("event_id")) % 3
    events = live(t).table("events").withColumn("tool_name", F.when(k == 0, "sql").when(k == 1, "search").otherwise("chart"))
    return finished(t, W.stream_error_rate(events, F.col("event_type") == "error", by=["tool_name"])).withColumn("window_start", utc("window_start"))


@query(
    "stream_object_freshness",
    """WITH l AS (SELECT object_name, CASE WHEN hash_of % 3 > 0 THEN (1 + hash_of % 3) * 7200 END AS gap FROM (SELECT DISTINCT object_name, length(object_name) + ascii(right(object_name, 1)) AS hash_of FROM run_history)),
    h AS (SELECT object_name, ts, to_seconds(coalesce(gap, 86400)) AS gap FROM run_history JOIN l USING (object_name)),
    o AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + gap OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY object_name ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY object_name ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o),
    g AS (SELECT object_name, count(*) AS runs, min(ts) AS first_seen, max(ts) + any_value(gap) AS silent_from FROM s GROUP BY object_name, k)
    SELECT * FROM g WHERE silent_from <= (SELECT max(ts) - INTERVAL 1 HOUR FROM run_history)""",
    ("run_history",),
)
def _(t):
    code = F.length("object_name") + F.ascii(F.right("object_name", F.lit(1)))
    lags = t.run_history.select("object_name").distinct().filter(code % 3 > 0).select("object_name", ((1 + code % 3) * 2400).alias("target_lag_seconds"))
    return finished(t, W.stream_freshness(live(t).run_history, lags=lags)).withColumns({"first_seen": utc("first_seen"), "silent_from": utc("silent_from")})


@query("stream_triage", QUERIES["triage"].sql.replace("schema_name = 'CORE'", "false"), QUERIES["triage"].uses)
def _(t):
    objects = triage_objects(t)
    arriving = objects.select("full_name", "schema_name", "table_name", "is_transient", "queries", "users", "row_count", "column_count")
    known = objects.filter("is_known").select("full_name", "previous_rows", "previous_columns", "quality_score")
    return finished(t, W.stream_triage(replay(t, arriving), known))


@query(
    "stream_catalog_delta",
    f"""WITH {hash_sql("o", "catalog_columns")}, {hash_sql("n", "catalog_columns_new")}
    SELECT database_name, schema_name, table_name, coalesce(n.schema_hash, o.schema_hash) AS schema_hash,
      CASE WHEN o.schema_hash IS NULL THEN 'insert' WHEN n.schema_hash IS NOT NULL AND n.schema_hash <> o.schema_hash THEN 'update' ELSE 'keep' END AS action
    FROM o FULL JOIN n USING (database_name, schema_name, table_name)""",
    ("catalog_columns", "catalog_columns_new"),
)
def _(t):
    return W.catalog_table(t.spark, _crawled(t))


@query("stream_ontology_drift", QUERIES["ontology_drift"].sql, QUERIES["ontology_drift"].uses)
def _(t):
    return t.spark.read.parquet(f"{_crawled(t)}/drift").drop("version")


def _crawled(t) -> str:
    """Folder of the table that the old catalog and then a stream of the new one left."""
    root = scratch_folder(t.spark)
    classes = classes_of(t).select("class_name", F.col("source_name").alias("source_table"))
    writer = W.catalog_delta_writer(t.spark, f"{root}/table", classes)
    writer(K.hashed(t.catalog_columns), 0)
    stream = replay(t, K.hashed(t.catalog_columns_new))
    offset = lambda batch, batch_id: writer(batch, batch_id + 1)
    stream.writeStream.foreachBatch(offset).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{root}/table"


# ---- models ----

_RULES = {"o_orderpriority": [(["1-URGENT", "2-HIGH"], 2), (["3-MEDIUM"], 1)], "o_orderstatus": [(["F"], 1), (["P"], 2)]}


@query(
    "encode",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 2 WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END AS BIGINT) AS o_orderpriority_code,
        CAST(CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END AS BIGINT) AS o_orderstatus_code FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL""",
)
def _(t):
    return M.encode(t.table("orders"), _RULES).select("o_orderkey", "o_orderpriority_code", "o_orderstatus_code")


_TEST = "CAST('0x' || substr(md5('42:' || o_orderkey), 1, 8) AS BIGINT) % 10000 < 2000"


@query("split", f"SELECT o_orderkey, CASE WHEN {_TEST} THEN 'TEST' ELSE 'TRAIN' END AS part FROM orders")
def _(t):
    train, test = M.split(t.table("orders").select("o_orderkey"), "o_orderkey")
    return train.withColumn("part", F.lit("TRAIN")).unionByName(test.withColumn("part", F.lit("TEST")))


@query(
    "classification_metrics",
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn FROM (
        SELECT quality AS y, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)))
    SELECT n, tp, fp, fn, round((n - fp - fn) / CAST(n AS DOUBLE), 6) AS accuracy, round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 6) AS precision,
      round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 6) AS recall, round(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 6) AS f1 FROM c""",
)
def _(t):
    rows = t.table("labels").join(t.table("documents").select("doc_id", "n_chars"), "doc_id")
    return M.classification_metrics(rows.withColumn("predicted", F.when(F.col("n_chars") > 400, 1).otherwise(0)), "quality")


def _features(t):
    d = t.table("documents").select(
        "doc_id", "n_chars", F.size(F.split("text", "\n")).alias("lines"), F.size(F.split("text", " ")).alias("words"),
        F.regexp_count("text", F.lit(r"[0-9]")).alias("digits"), F.size(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("distinct_words"),
    )
    return t.table("labels").join(d, "doc_id")


@query("train_and_score")
def _(t):
    """Documents with a label, scored by trees trained on the training part only."""
    rows = _features(t)
    train, test = M.split(rows, "doc_id")
    model = M.train(train, ["n_chars", "lines", "words", "digits", "distinct_words"], "quality")
    return M.score(test, model).select("doc_id", "quality", "predicted")
