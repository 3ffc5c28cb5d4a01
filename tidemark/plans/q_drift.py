"""Drift and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exact import as_large
from tidemark.operators import catalog as K
from tidemark.operators import drift as D
from tidemark.operators import sqlmining as X
from tidemark.operators.usage import domain_of, flatten_access, since as spark_since
from tidemark.plans.inputs import AS_OF, EVENTS_AS_OF, pick
from tidemark.plans.oracle_inputs import pick as sql_pick
from tidemark.plans.q_usage import ALL_DAYS, since
from tidemark.plans.registry import QUERIES, query
import tidemark.plans.q_sqlmining  # noqa: F401  (its checks are read below)

_AS_OF = f"TIMESTAMP '{AS_OF}'"
_EV = f"TIMESTAMP '{EVENTS_AS_OF}'"
_FQN = "database_name || '.' || schema_name || '.' || table_name"
_BOTH = ("catalog_columns", "catalog_columns_new")

_DIFF = """diff AS (SELECT * FROM (SELECT database_name, schema_name, table_name, column_name,
    CASE WHEN d.data_type IS NULL THEN 'NEW_IN_SOURCE' WHEN s.data_type IS NULL THEN 'DROPPED_IN_SOURCE' WHEN d.data_type <> s.data_type THEN 'TYPE_CHANGE'
      WHEN d.numeric_precision < s.numeric_precision THEN 'PRECISION_WIDENED' WHEN d.char_length < s.char_length THEN 'LENGTH_WIDENED' END AS drift_type
    FROM catalog_columns d FULL JOIN catalog_columns_new s USING (database_name, schema_name, table_name, column_name)) WHERE drift_type IS NOT NULL),
  sdiff AS (SELECT *, CASE WHEN drift_type IN ('DROPPED_IN_SOURCE', 'TYPE_CHANGE') THEN 'HIGH' WHEN drift_type = 'PRECISION_WIDENED' THEN 'MED' WHEN drift_type = 'LENGTH_WIDENED' THEN 'LOW' ELSE 'INFO' END AS severity,
    CASE WHEN drift_type IN ('DROPPED_IN_SOURCE', 'TYPE_CHANGE') THEN 'ADD' ELSE 'REVIEW' END AS recommendation FROM diff)"""


@query("schema_diff", f"WITH {_DIFF} SELECT * FROM sdiff", _BOTH)
def _(t):
    return D.schema_diff(t.catalog_columns, t.catalog_columns_new)


_NEWCOL = """ncol AS (SELECT database_name, schema_name, table_name, column_name, CAST(
    CASE WHEN regexp_matches(column_name, '_AT|_ETL|_LOAD|_BATCH|_DW_|_TS_|SRC_|META_') THEN -3 ELSE 3 END
    + CASE WHEN regexp_matches(column_name, 'AMOUNT|PRICE|STATUS|TYPE|DATE|NAME|CODE|ID|COUNT') THEN 2 ELSE 0 END
    + CASE WHEN data_type IN ('VARCHAR', 'NUMBER', 'DATE', 'TIMESTAMP') THEN 1 ELSE 0 END + CASE WHEN ordinal > n - 2 THEN 1 ELSE 0 END
    - CASE WHEN data_type IN ('VARIANT', 'OBJECT', 'ARRAY') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(column_name, 'EMAIL|SSN|PHONE|DOB|ADDRESS') THEN 2 ELSE 0 END
    - CASE WHEN nullable AND ordinal * 2 <= n THEN 1 ELSE 0 END - CASE WHEN column_name = 'NOTES' THEN 3 ELSE 0 END AS BIGINT) AS score
  FROM (SELECT *, count(*) OVER (PARTITION BY database_name, schema_name, table_name) AS n FROM catalog_columns_new))"""
_REC = "CASE WHEN score >= 4 THEN 'ADD' WHEN score >= 1 THEN 'REVIEW' ELSE 'SKIP' END"


def _new_columns(t):
    n = t.catalog_columns_new.groupBy(*K.TABLE_KEY).agg(F.count(F.lit(1)).alias("column_count"))
    return D.score_new_column(t.catalog_columns_new.join(as_large(n), K.TABLE_KEY).withColumn("all_null", F.col("column_name") == "NOTES"))


@query("score_new_column", f"WITH {_NEWCOL} SELECT *, {_REC} AS recommendation FROM ncol", ("catalog_columns_new",))
def _(t):
    return _new_columns(t)


@query(
    "null_probe",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS non_null_count, count({c}) > 0 AS is_ready FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
)
def _(t):
    return D.null_probe(t.table("customer"))


def _inner(name: str) -> str:
    return QUERIES[name].sql


@query(
    "score_table_gap",
    f"""
    WITH cand AS ({_inner("candidate_tables")}), n AS (SELECT table_name AS candidate_table, count(*) AS column_count FROM catalog_columns GROUP BY 1),
    s AS (SELECT cand.*, column_count, CAST(CASE WHEN pct_of_queries >= 30 THEN 3 WHEN pct_of_queries >= 10 THEN 2 WHEN pct_of_queries >= 5 THEN 1 ELSE 0 END
      + CASE WHEN unique_users >= 5 THEN 2 ELSE 0 END + CASE WHEN column_count <= 10 THEN 1 ELSE 0 END - CASE WHEN column_count > 30 THEN 2 ELSE 0 END
      - CASE WHEN column_count + 95 > 100 THEN 3 ELSE 0 END - CASE WHEN regexp_matches(candidate_table, '_LOG|_AUDIT|_HIST|_STG|_RAW') THEN 3 ELSE 0 END
      + CASE WHEN candidate_table = 'RECENT' THEN 1 ELSE 0 END AS BIGINT) AS score FROM cand LEFT JOIN n USING (candidate_table))
    SELECT *, {_REC} AS recommendation FROM s
    """,
    ("query_log", "catalog_columns"),
)
def _(t):
    counts = t.catalog_columns.groupBy(F.col("table_name").alias("candidate_table")).agg(F.count(F.lit(1)).alias("column_count"))
    return D.score_table_gap(X.candidate_tables(t.query_log, "DIM_|FCT_", AS_OF, ALL_DAYS), counts, 95, ["RECENT"])


@query(
    "score_column_gap",
    f"""
    WITH cand AS ({_inner("candidate_columns")}),
    s AS (SELECT *, CAST(CASE WHEN contains(usage_contexts, 'filter') THEN 3 ELSE 0 END + CASE WHEN contains(usage_contexts, 'group_by') THEN 2 ELSE 0 END
      + CASE WHEN unique_users >= 3 THEN 2 ELSE 0 END + CASE WHEN query_count >= 10 THEN 1 ELSE 0 END
      - CASE WHEN regexp_matches(candidate_col, '_AT|_ETL|_LOAD|_BATCH|_DW_|_TS_|SRC_|META_') THEN 3 ELSE 0 END
      - CASE WHEN regexp_matches(candidate_col, 'EMAIL|SSN|PHONE|DOB') THEN 2 ELSE 0 END - CASE WHEN candidate_col = 'REGION' THEN 2 ELSE 0 END AS BIGINT) AS score FROM cand)
    SELECT *, {_REC} AS recommendation FROM s
    """,
    ("query_log",),
)
def _(t):
    return D.score_column_gap(X.candidate_columns(t.query_log, "DIM_|FCT_", ["STATUS_CODE"], AS_OF, ALL_DAYS), ["REGION"])


@query(
    "dimension_samples",
    """
    WITH v AS (SELECT DISTINCT 'p_brand' AS column_name, p_brand AS value FROM part UNION SELECT DISTINCT 'p_name', p_name FROM part)
    SELECT column_name, rn AS position, value, 'ADD' AS recommendation FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value) AS rn FROM v) WHERE rn <= 10
    """,
)
def _(t):
    return D.dimension_samples(t.table("part"), ["p_type"])


@query(
    "refresh_health",
    f"""
    WITH w AS (SELECT *, ts >= {_EV} - INTERVAL 3 DAY AS sh FROM run_history WHERE ts >= {_EV} - INTERVAL 7 DAY),
    h AS (SELECT object_name, bool_or(sh) AS a FROM w GROUP BY 1),
    l AS (SELECT w.* FROM w JOIN h USING (object_name) WHERE sh OR NOT a QUALIFY row_number() OVER (PARTITION BY object_name ORDER BY ts DESC, run_id DESC) <= 20),
    g AS (SELECT object_name, count(*) AS refreshes, count(*) FILTER (state = 'FAILED') AS failed, arg_max(state, (ts, run_id)) AS last_state, max(ts) AS last_refresh FROM l GROUP BY 1)
    SELECT *, CASE WHEN failed > 0 THEN 'FAILED' WHEN last_refresh < {_EV} - INTERVAL 48 HOUR THEN 'STALE' ELSE 'OK' END AS health FROM g
    """,
    ("run_history",),
)
def _(t):
    return D.refresh_health(t.run_history, EVENTS_AS_OF, 24)


def _observed(t):
    e = F.col("event_id")
    bad = F.col("event_type") == "error"
    return t.table("events").select(
        "ts", F.when(bad, "ERROR").otherwise("OK").alias("status"), F.concat(F.lit("question "), F.when(F.col("user_id") % 3 == 0, "and then " * 30).otherwise(""), (F.col("user_id") % 30).cast("string")).alias("question"),
        F.when(bad | (e % 40 == 0), pick(["timeout", "bad reply", "no access"], e)).alias("error_message"), pick(["sql", "search", "chart"], F.col("user_id") + e).alias("tool_name"),
    )


_OBS = f"""obs AS (SELECT ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status, 'question ' || CASE WHEN user_id % 3 = 0 THEN repeat('and then ', 30) ELSE '' END || CAST(user_id % 30 AS VARCHAR) AS question,
  CASE WHEN event_type = 'error' OR event_id % 40 = 0 THEN {sql_pick(["timeout", "bad reply", "no access"], "event_id")} END AS error_message,
  {sql_pick(["sql", "search", "chart"], "user_id + event_id")} AS tool_name FROM events)"""
_ERR = "count(*) FILTER (status = 'ERROR')"


@query("error_rate_daily", f"WITH {_OBS} SELECT CAST(ts AS DATE) AS day, count(*) AS total_requests, {_ERR} AS error_count, round({_ERR} * 100.0::DOUBLE / count(*), 1) AS error_pct FROM obs GROUP BY 1")
def _(t):
    return D.error_rate_daily(_observed(t))


@query(
    "unanswered_intents",
    f"""WITH {_OBS}, g AS (SELECT question AS sample_question, status, error_message, count(*) AS occurrence_count FROM obs WHERE status = 'ERROR' OR error_message IS NOT NULL GROUP BY 1, 2, 3)
    SELECT *, CASE WHEN occurrence_count >= 10 THEN 'HIGH' WHEN occurrence_count >= 3 THEN 'MED' ELSE 'LOW' END AS priority FROM g ORDER BY occurrence_count DESC, sample_question, status, error_message NULLS FIRST LIMIT 20""",
)
def _(t):
    return D.unanswered_intents(_observed(t))


@query(
    "tool_failures",
    f"""WITH {_OBS}, g AS (SELECT tool_name, count(*) AS call_count, {_ERR} AS error_count, round({_ERR} * 100.0::DOUBLE / count(*), 1) AS error_pct, min(error_message) AS sample_error FROM obs GROUP BY 1)
    SELECT *, CASE WHEN error_pct > 20 THEN 'ADD' ELSE 'NONE' END AS recommendation FROM g""",
)
def _(t):
    return D.tool_failures(_observed(t))


_MANIFEST = f"""{_DIFF}, {_NEWCOL},
  sug AS (SELECT 'TYPE_DRIFT' AS kind, {_FQN} || '.' || column_name AS item, severity, drift_type, CAST(NULL AS BIGINT) AS score, recommendation FROM sdiff WHERE drift_type <> 'NEW_IN_SOURCE'
    UNION ALL SELECT 'NEW_COLUMN', {_FQN} || '.' || column_name, 'INFO', NULL, score, {_REC} FROM ncol SEMI JOIN (SELECT * FROM diff WHERE drift_type = 'NEW_IN_SOURCE') USING (database_name, schema_name, table_name, column_name)
    UNION ALL SELECT 'BYPASS', user_name, 'INFO', NULL, NULL, 'ADD' FROM query_log GROUP BY user_name HAVING count(*) > 3),
  man AS (SELECT row_number() OVER (ORDER BY CASE WHEN drift_type = 'DROPPED_IN_SOURCE' THEN 0 WHEN severity = 'HIGH' THEN 1 WHEN severity = 'MED' THEN 2 WHEN severity = 'LOW' THEN 3 ELSE 4 END,
      -coalesce(score, 0), CASE kind WHEN 'TABLE_GAP' THEN 0 WHEN 'NEW_COLUMN' THEN 1 WHEN 'COLUMN_GAP' THEN 2 WHEN 'TYPE_DRIFT' THEN 3 WHEN 'INDEX_GAP' THEN 4 ELSE 5 END, md5(kind || '|' || item)) AS number,
    kind, item, severity, score, CASE WHEN kind = 'BYPASS' THEN 'INFO' ELSE recommendation END AS recommendation FROM sug)"""
_MUSES = ("catalog_columns", "catalog_columns_new", "query_log")


def _manifest(t):
    diff = D.schema_diff(t.catalog_columns, t.catalog_columns_new)
    item = F.concat_ws(".", K.full_name(), "column_name").alias("item")
    none = F.lit(None).cast("string").alias("drift_type")
    typed = diff.filter("drift_type <> 'NEW_IN_SOURCE'").select(F.lit("TYPE_DRIFT").alias("kind"), item, "severity", "drift_type", F.lit(None).cast("bigint").alias("score"), "recommendation")
    new = _new_columns(t).join(as_large(diff.filter("drift_type = 'NEW_IN_SOURCE'")), [*K.TABLE_KEY, "column_name"], "left_semi").select(
        F.lit("NEW_COLUMN").alias("kind"), item, F.lit("INFO").alias("severity"), none, "score", "recommendation"
    )
    bypass = t.query_log.groupBy("user_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 3").select(
        F.lit("BYPASS").alias("kind"), F.col("user_name").alias("item"), F.lit("INFO").alias("severity"), none, F.lit(None).cast("bigint").alias("score"), F.lit("ADD").alias("recommendation")
    )
    return D.drift_manifest(typed.unionByName(new).unionByName(bypass))


@query("drift_manifest", f"WITH {_MANIFEST} SELECT * FROM man", _MUSES)
def _(t):
    return _manifest(t)


@query(
    "apply_approvals",
    f"WITH {_MANIFEST} SELECT * FROM man WHERE ((severity = 'HIGH' AND recommendation <> 'SKIP') OR kind = 'NEW_COLUMN') AND NOT starts_with(item, 'SALES')",
    _MUSES,
)
def _(t):
    m = _manifest(t)
    choices = m.filter("kind = 'NEW_COLUMN' or item like 'SALES%'").select("number", F.when(F.col("item").startswith("SALES"), "S").otherwise("A").alias("choice"))
    return D.apply_approvals(m, choices, "HIGH")


@query(
    "freshness",
    f"""WITH o AS (SELECT object_name, max(ts) AS d, CAST(3600 * (1 + user_id % 30) AS BIGINT) AS target_lag_sec FROM run_history WHERE state = 'SUCCEEDED' AND user_id % 11 > 0 GROUP BY object_name, user_id),
    l AS (SELECT object_name, target_lag_sec, CAST(floor((epoch_us({_EV}) - epoch_us(d)) / 1000000) AS BIGINT) AS lag_sec FROM o)
    SELECT *, CASE WHEN lag_sec > 3 * target_lag_sec THEN 'STALE' ELSE 'WARN' END AS status FROM l WHERE lag_sec > 2 * target_lag_sec""",
    ("run_history",),
)
def _(t):
    objects = t.run_history.filter("state = 'SUCCEEDED'").groupBy("object_name", "user_id").agg(F.max("ts").alias("data_ts")).select(
        "object_name", "data_ts", ((1 + F.col("user_id") % 30) * 3600).alias("target_lag_sec"), (F.col("user_id") % 11 > 0).alias("is_active")
    )
    return D.freshness(objects, EVENTS_AS_OF)


@query(
    "empty_tables",
    f"SELECT {_FQN} AS full_name, CASE WHEN owner = 'ROLE_3' THEN 'WARNING_REGRESSION' ELSE 'EMPTY' END AS status FROM catalog_tables WHERE table_type = 'BASE TABLE' AND row_count = 0",
    ("catalog_tables",),
)
def _(t):
    return D.empty_tables(t.catalog_tables, t.catalog_tables.filter("owner = 'ROLE_3'").select(K.full_name().alias("full_name")))


@query(
    "baseline_drift",
    """SELECT * FROM (SELECT database_name, schema_name, table_name, column_name, d.data_type AS old_type, s.data_type AS new_type,
      CASE WHEN d.data_type IS NULL THEN 'NEW' WHEN s.data_type IS NULL THEN 'REMOVED' WHEN d.data_type <> s.data_type THEN 'TYPE_CHANGED' END AS change
      FROM catalog_columns d FULL JOIN catalog_columns_new s USING (database_name, schema_name, table_name, column_name)) WHERE change IS NOT NULL""",
    _BOTH,
)
def _(t):
    return D.baseline_drift(t.catalog_columns, t.catalog_columns_new)


_PCT = "round({a} * 100.0::DOUBLE / count(*), 1)"


@query(
    "comment_coverage",
    f"""WITH t AS (SELECT database_name, schema_name, count(*) AS total_tables, {_PCT.format(a="count(comment)")} AS table_comment_pct FROM catalog_tables WHERE table_type = 'BASE TABLE' GROUP BY 1, 2),
    c AS (SELECT database_name, schema_name, count(*) AS total_columns, {_PCT.format(a="count(comment)")} AS column_comment_pct, {_PCT.format(a="count(*) FILTER (data_type IN ('TEXT', 'VARCHAR'))")} AS text_pct FROM catalog_columns GROUP BY 1, 2)
    SELECT * FROM c LEFT JOIN t USING (database_name, schema_name)""",
    ("catalog_tables", "catalog_columns"),
)
def _(t):
    return D.comment_coverage(t.catalog_tables, t.catalog_columns)


@query(
    "readiness_score",
    f"""WITH t AS (SELECT database_name AS domain, {_PCT.format(a="count(comment)")} AS table_comment_pct, date_diff('day', max(last_altered), {_AS_OF}) + 5 AS days_since_change FROM catalog_tables GROUP BY 1),
    c AS (SELECT database_name AS domain, {_PCT.format(a="count(comment)")} AS column_comment_pct, count(*) FILTER (column_name = 'EMAIL') AS pii_unmasked FROM catalog_columns GROUP BY 1),
    q AS (SELECT database_name AS domain, count(*) AS query_volume, count(DISTINCT user_name) AS user_count, round(count(*) FILTER (status = 'FAIL') * 10.0::DOUBLE / count(*), 1) AS error_rate_pct FROM query_log GROUP BY 1),
    k AS (SELECT database_name AS domain, count(*) AS n FROM constraints GROUP BY 1),
    s AS (SELECT *, coalesce(k.n, 0) % 60 AS fk_pct FROM t JOIN c USING (domain) JOIN q USING (domain) LEFT JOIN k USING (domain)),
    v AS (SELECT domain, 20 * CASE WHEN table_comment_pct > 60 THEN 1.0::DOUBLE WHEN table_comment_pct >= 30 THEN 0.5 ELSE 0 END AS a, 15 * CASE WHEN column_comment_pct > 50 THEN 1.0::DOUBLE WHEN column_comment_pct >= 20 THEN 0.5 ELSE 0 END AS b,
      15 * CASE WHEN query_volume > 100 THEN 1.0::DOUBLE WHEN query_volume >= 20 THEN 0.5 ELSE 0 END AS c, 10 * CASE WHEN user_count > 5 THEN 1.0::DOUBLE WHEN user_count >= 2 THEN 0.5 ELSE 0 END AS d,
      10 * CASE WHEN error_rate_pct < 3 THEN 1.0::DOUBLE WHEN error_rate_pct <= 10 THEN 0.5 ELSE 0 END AS e, 10 * CASE WHEN fk_pct > 50 THEN 1.0::DOUBLE WHEN fk_pct >= 20 THEN 0.5 ELSE 0 END AS f,
      10 * CASE WHEN days_since_change < 7 THEN 1.0::DOUBLE WHEN days_since_change <= 60 THEN 0.5 ELSE 0 END AS g, 10 * CASE WHEN pii_unmasked < 1 THEN 1.0::DOUBLE WHEN pii_unmasked <= 2 THEN 0.5 ELSE 0 END AS h FROM s)
    SELECT domain, round(a + b + c + d + e + f + g + h, 1) AS score, concat_ws(',', CASE WHEN a = 0 THEN 'table_comment_pct' END, CASE WHEN b = 0 THEN 'column_comment_pct' END, CASE WHEN c = 0 THEN 'query_volume' END,
      CASE WHEN d = 0 THEN 'user_count' END, CASE WHEN e = 0 THEN 'error_rate_pct' END, CASE WHEN f = 0 THEN 'fk_pct' END, CASE WHEN g = 0 THEN 'days_since_change' END, CASE WHEN h = 0 THEN 'pii_unmasked' END) AS red_signals,
      CASE WHEN domain = 'PEOPLE' THEN 'BLOCKED' WHEN a + b + c + d + e + f + g + h >= 75 THEN 'CLEAN' WHEN a + b + c + d + e + f + g + h >= 40 THEN 'ASK' ELSE 'ENRICH' END AS path FROM v""",
    ("catalog_tables", "catalog_columns", "query_log", "constraints"),
)
def _(t):
    from tidemark.functions.exact import percent, rounded

    db = F.col("database_name").alias("domain")
    n = F.count(F.lit(1))
    a = t.catalog_tables.groupBy(db).agg(percent(F.count("comment"), n).alias("table_comment_pct"), (F.datediff(F.lit(AS_OF).cast("timestamp_ntz"), F.max("last_altered")) + 5).alias("days_since_change"))
    b = t.catalog_columns.groupBy(db).agg(percent(F.count("comment"), n).alias("column_comment_pct"), F.count_if(F.col("column_name") == "EMAIL").alias("pii_unmasked"))
    c = t.query_log.groupBy(db).agg(n.alias("query_volume"), F.count_distinct("user_name").alias("user_count"), rounded(F.count_if(F.col("status") == "FAIL") * 10.0 / n, 1).alias("error_rate_pct"))
    k = t.constraints.groupBy(db).agg(n.alias("_k"))
    s = a.join(b, "domain").join(c, "domain").join(k, "domain", "left").withColumn("fk_pct", F.coalesce("_k", F.lit(0)) % 60).withColumn("is_blocked", F.col("domain") == "PEOPLE")
    return D.readiness_score(s)


@query(
    "metric_conflicts",
    f"""WITH n AS (SELECT column_name, count(DISTINCT {_FQN}) AS table_count FROM catalog_columns GROUP BY 1 HAVING count(DISTINCT {_FQN}) > 2)
    SELECT column_name, {_FQN} AS full_name, data_type, table_count FROM catalog_columns JOIN n USING (column_name) WHERE data_type IN ('NUMBER', 'FLOAT', 'DECIMAL')""",
    ("catalog_columns",),
)
def _(t):
    return D.metric_conflicts(t.catalog_columns)


@query(
    "entity_conflicts",
    f"""WITH h AS (SELECT * FROM catalog_tables WHERE regexp_matches(table_name, 'CUSTOMER|ACCOUNT') AND row_count > 0),
    s AS (SELECT database_name, max(row_count) AS hi, min(row_count) AS lo FROM h GROUP BY 1)
    SELECT {_FQN} AS full_name, row_count, round(hi / CAST(row_count AS DOUBLE), 2) AS ratio_to_largest FROM h JOIN s USING (database_name) WHERE hi >= lo * 10""",
    ("catalog_tables",),
)
def _(t):
    return D.entity_conflicts(t.catalog_tables, "CUSTOMER|ACCOUNT")


_TOOLS = ["metrics_layer", "bi_measure", "calculated_field", "none"]


@query(
    "trust_score",
    f"""WITH u AS (SELECT query_type AS metric, database_name AS definition, user_name, count(*) AS n FROM query_log GROUP BY 1, 2, 3),
    d AS (SELECT query_type AS metric, database_name AS definition, count(*) AS executions, count(DISTINCT user_name) AS users, count(*) FILTER (elapsed_ms > 400000) AS scheduled, count(*) FILTER (status = 'FAIL' AND elapsed_ms < 50000) AS errors,
        count(*) FILTER (start_time >= TIMESTAMP '1999-01-01') AS recent, count(*) FILTER (start_time < TIMESTAMP '1999-01-01') AS earlier FROM query_log GROUP BY 1, 2),
    x AS (SELECT d.*, (SELECT max(n) FROM u WHERE u.metric = d.metric AND u.definition = d.definition) AS top_user, {sql_pick(_TOOLS, "length(definition)")} AS tool FROM d),
    p AS (SELECT metric, max(executions) AS pe, max(users) AS pu, max(scheduled) AS ps FROM x GROUP BY 1)
    SELECT metric, definition, round(least(executions / CAST(pe AS DOUBLE) * 30 + users / CAST(pu AS DOUBLE) * 25 + coalesce(scheduled / CAST(nullif(ps, 0) AS DOUBLE), 0) * 20 + (1 - least(errors / CAST(executions AS DOUBLE) * 10, 1.0)) * 15
      + CASE WHEN recent > earlier THEN 1.0::DOUBLE WHEN recent = earlier THEN 0.5 ELSE 0 END * 10 + CASE tool WHEN 'metrics_layer' THEN 35 WHEN 'bi_measure' THEN 30 WHEN 'calculated_field' THEN 25 ELSE 0 END, 100.0), 1) AS score,
      top_user > executions * 0.8 AS single_user, errors / CAST(executions AS DOUBLE) > 0.1 AS high_error FROM x JOIN p USING (metric)""",
    ("query_log",),
)
def _(t):
    q = t.query_log
    key = [F.col("query_type").alias("metric"), F.col("database_name").alias("definition")]
    at = F.lit("1999-01-01").cast("timestamp_ntz")
    per_user = q.groupBy(*key, "user_name").agg(F.count(F.lit(1)).alias("n")).groupBy("metric", "definition").agg(F.max("n").alias("top_user_executions"))
    d = q.groupBy(*key).agg(
        F.count(F.lit(1)).alias("executions"), F.count_distinct("user_name").alias("users"), F.count_if(F.col("elapsed_ms") > 400000).alias("scheduled"),
        F.count_if((F.col("status") == "FAIL") & (F.col("elapsed_ms") < 50000)).alias("errors"), F.count_if(F.col("start_time") >= at).alias("recent"), F.count_if(F.col("start_time") < at).alias("earlier"),
    )
    return D.trust_score(d.join(per_user, ["metric", "definition"]).withColumn("tool", pick(_TOOLS, F.length("definition"))))


@query(
    "documentation_gaps",
    f"""WITH u AS (SELECT DISTINCT upper(unnest(regexp_extract_all(query_text, '\\.([A-Z_]+)', 1))) AS c FROM query_log)
    SELECT {_FQN} AS item, 'UNDOCUMENTED_TABLE' AS gap FROM catalog_tables WHERE table_type = 'BASE TABLE' AND comment IS NULL
    UNION ALL SELECT {_FQN} || '.' || column_name, 'UNDOCUMENTED_USED_COLUMN' FROM catalog_columns WHERE comment IS NULL AND column_name IN (SELECT c FROM u)
    UNION ALL SELECT {_FQN}, 'LARGE_WITHOUT_TEXT' FROM catalog_tables WHERE table_type = 'BASE TABLE' AND comment IS NULL AND row_count > 10000
      AND {_FQN} NOT IN (SELECT {_FQN} FROM catalog_columns WHERE comment IS NOT NULL)
    UNION ALL SELECT database_name || '.' || schema_name, 'NO_FOREIGN_KEYS' FROM (SELECT DISTINCT database_name, schema_name FROM catalog_tables)
      WHERE database_name || '.' || schema_name NOT IN (SELECT database_name || '.' || schema_name FROM constraints)""",
    ("catalog_tables", "catalog_columns", "query_log", "constraints"),
)
def _(t):
    used = t.query_log.select(F.explode(F.regexp_extract_all("query_text", F.lit(r"\.([A-Z_]+)"), 1)).alias("column_name")).distinct()
    return D.documentation_gaps(t.catalog_tables, t.catalog_columns, used, t.constraints)


@query(
    "large_unclustered",
    f"""SELECT {_FQN} AS full_name, row_count FROM catalog_tables WHERE row_count > 20000000 AND size_code % 3 > 0 AND {_FQN} IN (SELECT full_name FROM concepts)""",
    ("catalog_tables", "concepts"),
)
def _(t):
    tables = t.catalog_tables.withColumn("clustering_key", F.when(F.col("size_code") % 3 == 0, "ID"))
    return D.large_unclustered(tables, t.concepts.select("full_name"), 20_000_000)


@query(
    "recent_domain_changes",
    f"""SELECT {_FQN} AS full_name, date_diff('day', last_altered, {_AS_OF}) AS days_since_change FROM catalog_tables WHERE last_altered > {_AS_OF} - INTERVAL 30 DAY AND {_FQN} IN (SELECT full_name FROM concepts)""",
    ("catalog_tables", "concepts"),
)
def _(t):
    return D.recent_domain_changes(t.catalog_tables, t.concepts.select("full_name"), AS_OF, 30)


@query(
    "auto_exclusions",
    f"""SELECT {_FQN} AS full_name, CASE WHEN regexp_matches(table_name, '(^|_)(TMP|TEMP|STG|STAGING|RAW|LOAD|BKP|BACKUP|OLD)(_|$|\\d)') THEN 'STAGING'
      WHEN {_FQN} NOT IN (SELECT object_name FROM access WHERE {since("ts", 365)}) THEN 'DORMANT' ELSE 'KEEP' END AS decision FROM catalog_tables""",
    ("catalog_tables", "access"),
)
def _(t):
    used = flatten_access(t.access_log.filter(spark_since("ts", AS_OF, 365))).select(F.col("object_name").alias("full_name"))
    return D.auto_exclusions(t.catalog_tables, used)


@query(
    "column_exclusions",
    f"""WITH cand AS ({_inner("candidate_columns")}) SELECT candidate_col, query_count, CASE WHEN query_count < 300 THEN 'EXCLUDE' WHEN usage_contexts = 'filter' THEN 'FILTER_DIMENSION' ELSE 'KEEP' END AS decision FROM cand""",
    ("query_log",),
)
def _(t):
    return D.column_exclusions(X.candidate_columns(t.query_log, "DIM_|FCT_", ["STATUS_CODE"], AS_OF, ALL_DAYS), 300)


@query(
    "resolve_gaps",
    f"""WITH g AS (SELECT part_key AS gap_id, column_item AS item, size_code % 13 = 0 AS is_blocking, CAST(size_code * 7 % 60 AS DOUBLE) AS share_pct, size_code % 70 AS trust
        FROM (SELECT *, {_FQN} AS column_item FROM catalog_tables WHERE comment IS NULL)),
    d AS (SELECT full_name AS item, max(CASE WHEN has_joins THEN 35 ELSE 25 END) AS b FROM concepts WHERE size_code % 2 = 0 GROUP BY 1),
    j AS (SELECT g.*, b FROM g LEFT JOIN d USING (item)),
    a AS (SELECT gap_id FROM j WHERE b IS NULL AND (is_blocking OR share_pct > 20) ORDER BY is_blocking DESC, share_pct DESC, gap_id LIMIT 15)
    SELECT gap_id, item, CASE WHEN b IS NOT NULL THEN 'CONFIRMED' WHEN gap_id IN (SELECT gap_id FROM a) THEN 'ASK' ELSE 'DEFAULT_LOW_CONFIDENCE' END AS resolution,
      CAST(least(trust + coalesce(b, 0), 100) AS BIGINT) AS trust FROM j""",
    ("catalog_tables", "concepts"),
)
def _(t):
    s = F.col("size_code")
    gaps = t.catalog_tables.filter("comment is null").select(
        F.col("part_key").alias("gap_id"), K.full_name().alias("item"), (s % 13 == 0).alias("is_blocking"), (s * 7 % 60).cast("double").alias("share_pct"), (s % 70).alias("trust")
    )
    definitions = t.concepts.filter("size_code % 2 = 0").select(F.col("full_name").alias("item"), F.when(F.col("has_joins"), 35).otherwise(25).alias("boost"))
    return D.resolve_gaps(gaps, definitions)


@query(
    "domain_gate",
    """WITH d AS (SELECT database_name || '.' || schema_name AS domain, count(*) FILTER (size_code % 40 = 1) AS entities, count(*) FILTER (size_code = 50) AS ob, count(*) FILTER (size_code = 49) AS un,
        count(*) FILTER (size_code = 3) AS metrics, count(*) FILTER (size_code < 4) AS questions, count(*) FILTER (size_code = 7) AS inf, count(*) FILTER (size_code = 8) AS low, count(*) FILTER (size_code = 9) AS fed FROM catalog_tables GROUP BY 1),
    x AS (SELECT domain, concat_ws(',', CASE WHEN entities < 1 THEN 'entities' END, CASE WHEN ob > 0 THEN 'conflicts_decided' END, CASE WHEN un > 0 THEN 'golden_records' END, CASE WHEN metrics < 1 THEN 'metrics' END,
        CASE WHEN questions < 3 THEN 'questions' END, CASE WHEN domain LIKE 'WEB%' THEN 'target_role' END, CASE WHEN domain LIKE '%RAW' THEN 'pii_resolved' END) AS missing,
      concat_ws(',', CASE WHEN inf > 0 THEN 'inferred_relations' END, CASE WHEN low > 0 THEN 'low_confidence' END, CASE WHEN fed > 0 THEN 'federated_metrics' END, CASE WHEN domain NOT LIKE 'SALES%' THEN 'no_tool' END) AS warnings FROM d)
    SELECT *, CASE WHEN missing = '' THEN 'PASS' ELSE 'HALT' END AS gate FROM x""",
    ("catalog_tables",),
)
def _(t):
    s, n = F.col("size_code"), F.count_if
    d = t.catalog_tables.groupBy(F.concat_ws(".", "database_name", "schema_name").alias("domain")).agg(
        n(s % 40 == 1).alias("entities"), n(s == 50).alias("open_blocking"), n(s == 49).alias("unknown_entities"), n(s == 3).alias("metrics"), n(s < 4).alias("questions"),
        n(s == 7).alias("inferred_relations"), n(s == 8).alias("low_confidence"), n(s == 9).alias("federated_metrics"),
    )
    c = F.col("domain")
    return D.domain_gate(d.withColumns({"has_target_role": ~c.startswith("WEB"), "pii_ok": ~c.endswith("RAW"), "access_ok": F.lit(True), "has_tool": c.startswith("SALES")}))


@query(
    "domain_names",
    "SELECT DISTINCT database_name, coalesce(nullif(regexp_replace(database_name, '(_DB|_DW|_PROD|_DEV|_STAGE|_STG)$', ''), ''), database_name) AS domain FROM catalog_tables",
    ("catalog_tables",),
)
def _(t):
    return t.catalog_tables.select("database_name", domain_of("database_name").alias("domain")).distinct()
