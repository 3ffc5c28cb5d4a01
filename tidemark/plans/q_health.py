"""Pipeline health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exact import as_large
from tidemark.operators import closure as C
from tidemark.operators import health as H
from tidemark.plans.inputs import AS_OF, EVENTS_AS_OF
from tidemark.plans.q_usage import ALL_DAYS, since
from tidemark.operators.usage import since as spark_since
from tidemark.plans.registry import query

_EV = f"TIMESTAMP '{EVENTS_AS_OF}'"

RUNBOOK = [
    ("does not exist", "OBJECT_NOT_FOUND", "ALL", "SELECT 'NEEDS_SCHEMA_LOOKUP'", 0.3),
    ("Numeric value .* is not recognized", "TYPE_ERROR", "ALL", "SELECT 'NEEDS_CAST_FIX'", 0.4),
    ("Statement timeout", "TIMEOUT", "TASK", "ALTER TASK {OBJECT} SET TIMEOUT = 7200", 0.8),
    ("timeout after \\d+ seconds", "TIMEOUT", "ALL", "ALTER TASK {OBJECT} RESUME", 0.95),
    ("Upstream refresh failed", "CASCADE", "DERIVED_TABLE", "ALTER DYNAMIC TABLE {OBJECT} REFRESH", 0.9),
    ("Out of memory", "RESOURCE", "ALL", "ALTER TABLE {OBJECT} SET SIZE = 'L'", 0.85),
]


def _runbook(spark):
    rows = [(*r, 0) for r in RUNBOOK]
    return spark.createDataFrame(
        rows, "error_pattern string, error_category string, object_type string, fix_template string, confidence double, times_used bigint"
    )


_BOOK = "book AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r[:4]) + f", {r[4]}::DOUBLE)" for r in RUNBOOK
) + ") v(error_pattern, error_category, object_type, fix_template, confidence))"

_MATCHED = f"""{_BOOK}, matched AS (
  SELECT f.failure_id, f.object_name, f.object_type, b.error_pattern, b.error_category, replace(b.fix_template, '{{OBJECT}}', f.object_name) AS fix, b.confidence
  FROM failures f LEFT JOIN (
    SELECT m.error_message, m.object_type AS ot, book.* FROM (SELECT DISTINCT error_message, object_type FROM failures) m
    JOIN book ON regexp_matches(m.error_message, book.error_pattern) AND book.object_type IN ('ALL', m.object_type)
    QUALIFY row_number() OVER (PARTITION BY m.error_message, m.object_type ORDER BY book.confidence DESC, book.error_pattern) = 1) b
  ON b.error_message = f.error_message AND b.ot = f.object_type)"""


@query(
    "detect_failures",
    f"""
    WITH k AS (SELECT * FROM failures WHERE status = 'RESOLVED'),
    f AS (SELECT * FROM run_history r WHERE ts > {_EV} - INTERVAL 48 HOUR AND state = 'FAILED' AND NOT EXISTS (
            SELECT 1 FROM k WHERE k.object_name = r.object_name AND k.object_type = r.object_type AND k.detected_at = r.ts))
    SELECT object_name, object_type, ts, state, message FROM f
    """,
    ("run_history", "failures"),
)
def _(t):
    return H.detect_failures(t.run_history, t.failures.filter("status = 'RESOLVED'"), EVENTS_AS_OF, 48)


@query("match_runbook", f"WITH {_MATCHED} SELECT * FROM matched", ("failures",))
def _(t):
    return H.match_runbook(t.failures, _runbook(t.spark))


@query(
    "runbook_usage",
    f"""
    WITH {_MATCHED} SELECT b.error_pattern, b.object_type, count(m.failure_id) AS times_used
    FROM book b LEFT JOIN matched m USING (error_pattern) GROUP BY 1, 2
    """,
    ("failures",),
)
def _(t):
    book = _runbook(t.spark)
    return H.runbook_usage(book, H.match_runbook(t.failures, book))


@query(
    "guardrail",
    f"""
    WITH {_MATCHED}, x AS (SELECT failure_id, confidence AS rc,
        CASE failure_id % 6 WHEN 0 THEN 'DROP TABLE ' || object_name WHEN 1 THEN 'create or replace view v as select 1'
          WHEN 2 THEN 'EXECUTE TASK ' || object_name WHEN 3 THEN 'CALL FIX()' ELSE fix END AS fix, (failure_id % 11) / 10.0::DOUBLE AS confidence FROM matched),
    u AS (SELECT *, upper(fix) AS s FROM x)
    SELECT failure_id, fix, CASE
      WHEN regexp_matches(s, 'DROP DATABASE|DROP SCHEMA|DROP TABLE|DROP VIEW|DROP DYNAMIC TABLE|DROP TASK|TRUNCATE|DELETE FROM|GRANT |REVOKE |CREATE USER|ALTER USER|CREATE ROLE|DROP ROLE') THEN 'BLOCK:BLOCKED_OPERATION'
      WHEN contains(s, '''NEEDS_') THEN 'REVIEW:NEEDS_DIAGNOSIS'
      WHEN (contains(s, 'ALTER ') AND NOT contains(s, 'ALTER TASK') AND NOT contains(s, 'ALTER DYNAMIC TABLE')) OR contains(s, 'CREATE OR REPLACE')
        THEN CASE WHEN rc >= 0.8 AND confidence >= 0.8 THEN 'PASS' ELSE 'REVIEW:BLOCKED_OPERATION' END
      WHEN ((contains(s, 'ALTER TASK') AND regexp_matches(s, 'RESUME|SET WAREHOUSE|SUSPEND')) OR (contains(s, 'ALTER DYNAMIC TABLE') AND contains(s, 'REFRESH'))
        OR contains(s, 'EXECUTE TASK') OR starts_with(s, 'SELECT')) AND confidence >= 0.8 THEN 'PASS'
      WHEN confidence < 0.8 THEN 'REVIEW:LOW_CONFIDENCE' WHEN s IS NULL THEN 'REVIEW:UNKNOWN_OPERATION' ELSE 'REVIEW:UNKNOWN_OPERATION' END AS guardrail
    FROM u
    """,
    ("failures",),
)
def _(t):
    m = H.match_runbook(t.failures, _runbook(t.spark))
    k = F.col("failure_id") % 6
    fix = (
        F.when(k == 0, F.concat(F.lit("DROP TABLE "), "object_name")).when(k == 1, "create or replace view v as select 1")
        .when(k == 2, F.concat(F.lit("EXECUTE TASK "), "object_name")).when(k == 3, "CALL FIX()").otherwise(F.col("fix"))
    )
    fixes = m.select(
        "failure_id", F.col("confidence").alias("runbook_confidence"), fix.alias("fix"), ((F.col("failure_id") % 11) / 10.0).alias("confidence")
    )
    return H.guardrail(fixes).select("failure_id", "fix", "guardrail")


_UPSTREAM = "Upstream refresh failed"


@query(
    "root_cause",
    f"""
    WITH RECURSIVE walk AS (
      SELECT DISTINCT node AS start, node, CAST(node AS VARCHAR) AS path, CAST(0 AS BIGINT) AS depth FROM failures WHERE regexp_matches(error_message, '{_UPSTREAM}')
      UNION ALL SELECT w.start, e.parent, w.path || '>' || CAST(e.parent AS VARCHAR), w.depth + 1 FROM walk w JOIN edges e ON e.child = w.node WHERE w.depth < 40),
    first AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY depth, path) = 1)
    SELECT f.failure_id, c.node AS root_cause, w.depth, w.path
    FROM failures f JOIN first w ON w.start = f.node AND w.depth > 0
    JOIN failures c ON c.node = w.node AND NOT regexp_matches(c.error_message, '{_UPSTREAM}')
      AND c.detected_at <= f.detected_at AND c.detected_at >= f.detected_at - INTERVAL 2 HOUR
    WHERE regexp_matches(f.error_message, '{_UPSTREAM}')
    QUALIFY row_number() OVER (PARTITION BY f.failure_id ORDER BY w.depth, c.node, w.path) = 1
    """,
    ("failures", "edges"),
)
def _(t):
    return C.root_cause(t.failures, t.edges, _UPSTREAM)


@query(
    "downstream_status",
    """
    WITH RECURSIVE n AS (SELECT DISTINCT node FROM failures WHERE status = 'RESOLVED'),
    walk AS (SELECT node AS start, node FROM n UNION SELECT w.start, e.child FROM walk w JOIN edges e ON e.parent = w.node),
    st AS (SELECT user_id AS node, any_value(object_type) AS object_type, arg_max(state, run_id) AS state FROM run_history GROUP BY 1),
    d AS (SELECT w.start, count(*) AS dependents, count(*) FILTER (st.state = 'FAILED') AS unhealthy
          FROM (SELECT DISTINCT start, node FROM walk WHERE start <> node) w LEFT JOIN st USING (node) GROUP BY 1)
    SELECT n.node, coalesce(dependents, 0) AS dependents, coalesce(unhealthy, 0) AS unhealthy,
      CASE WHEN coalesce(unhealthy, 0) = 0 THEN 'RESOLVED' ELSE 'ESCALATED' END AS outcome FROM n LEFT JOIN d ON d.start = n.node
    """,
    ("failures", "edges", "run_history"),
)
def _(t):
    states = t.run_history.groupBy(F.col("user_id").alias("node")).agg(
        F.max("object_type").alias("object_type"), F.max_by("state", "run_id").alias("state")
    )
    return C.downstream_status(t.failures.filter("status = 'RESOLVED'").select("node"), t.edges, states)


@query(
    "circuit_breaker",
    """
    SELECT *, CASE WHEN recent_escalations > 10 OR recent_fix_loops > 3 THEN 'CIRCUIT_BREAKER_TRIPPED' ELSE 'OK' END AS state FROM (
      SELECT count(*) FILTER (status = 'ESCALATED' AND detected_at > TIMESTAMP '2024-01-15 11:00:00') AS recent_escalations,
             count(*) FILTER (fix_attempts >= 3 AND status <> 'RESOLVED') AS recent_fix_loops
      FROM failures WHERE detected_at > TIMESTAMP '2024-01-15 10:00:00' AND detected_at <= TIMESTAMP '2024-01-15 12:00:00')
    """,
    ("failures",),
)
def _(t):
    at = "2024-01-15 12:00:00"
    return H.circuit_breaker(t.failures.filter(F.col("detected_at") <= F.lit(at).cast("timestamp_ntz")), at)


@query(
    "cost_anomaly",
    """
    SELECT date_trunc('hour', created_at) AS hour_window, count(*) AS model_calls, count(DISTINCT failure_id) AS unique_failures
    FROM audit_log WHERE action_type IN ('DIAGNOSE', 'DIAGNOSE_DT') AND model_used <> 'RUNBOOK' GROUP BY 1 HAVING count(*) > 3
    """,
    ("audit_log",),
)
def _(t):
    return H.cost_anomaly(t.audit_log, 3)


_SUMS = """count(*) AS {n}, count(*) FILTER (status = 'RESOLVED') AS auto_resolved, count(*) FILTER (status = 'ESCALATED') AS escalated"""
_PCT = "round(count(*) FILTER (status = 'RESOLVED') * 100.0::DOUBLE / count(*), 1) AS success_rate_pct"


@query(
    "health_kpis",
    f"""
    SELECT coalesce(object_type, 'ALL') AS object_type, {_SUMS.format(n="total")}, count(*) FILTER (status = 'PENDING_REVIEW') AS pending, {_PCT}
    FROM failures WHERE detected_at > {_EV} - INTERVAL 7 DAY GROUP BY ROLLUP (object_type)
    """,
    ("failures",),
)
def _(t):
    return H.health_kpis(t.failures, EVENTS_AS_OF)


@query(
    "failure_trend",
    f"SELECT CAST(detected_at AS DATE) AS day, {_SUMS.format(n='total_failures')}, {_PCT} FROM failures "
    f"WHERE detected_at > {_EV} - INTERVAL 30 DAY GROUP BY 1",
    ("failures",),
)
def _(t):
    return H.failure_trend(t.failures, EVENTS_AS_OF)


@query(
    "audit_mix",
    """
    SELECT model_used, guardrail_result, count(*) AS calls,
      round(CAST(sum(CAST(confidence AS DECIMAL(20,4))) AS DOUBLE) / count(confidence), 4) AS avg_confidence FROM audit_log GROUP BY 1, 2
    """,
    ("audit_log",),
)
def _(t):
    return H.audit_mix(t.audit_log)


@query(
    "latest_escalations",
    """
    SELECT object_name, object_type, error_message, fix_attempts, detected_at FROM failures WHERE status = 'ESCALATED'
    ORDER BY detected_at DESC, failure_id LIMIT 20
    """,
    ("failures",),
)
def _(t):
    return H.latest_escalations(t.failures)


_REVIEWS = """reviews AS (SELECT failure_id AS review_id, object_type, error_message, detected_at AS created_at,
  CASE status WHEN 'PENDING_REVIEW' THEN 'PENDING' WHEN 'RESOLVED' THEN 'APPROVED' ELSE 'REJECTED' END AS review_status FROM failures)"""


def _reviews(t):
    s = F.col("status")
    return t.failures.select(
        F.col("failure_id").alias("review_id"), "object_type", "error_message", F.col("detected_at").alias("created_at"),
        F.when(s == "PENDING_REVIEW", "PENDING").when(s == "RESOLVED", "APPROVED").otherwise("REJECTED").alias("review_status"),
    )


@query(
    "expire_reviews",
    f"""
    WITH {_REVIEWS} SELECT review_id, CASE WHEN review_status = 'PENDING' AND created_at <= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOUR
      THEN 'ESCALATED' ELSE review_status END AS review_status FROM reviews
    """,
    ("failures",),
)
def _(t):
    return H.expire_reviews(_reviews(t), "2024-01-20 12:00:00").select("review_id", "review_status")


@query(
    "learn_patterns",
    f"""
    WITH {_REVIEWS}, {_BOOK},
    g AS (SELECT regexp_replace(regexp_replace(error_message, '''[^'']*''', '''.*''', 'g'), '\\d+', '\\\\d+', 'g') AS candidate_pattern, object_type,
            count(*) AS fixes, min(error_message) AS sample_message FROM reviews WHERE review_status = 'APPROVED' GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM book WHERE regexp_matches(g.sample_message, book.error_pattern))
    """,
    ("failures",),
)
def _(t):
    return H.learn_patterns(_reviews(t), _runbook(t.spark))


CHANGES = [
    ("C1", "FLATTEN", "VIEW", "Generally Enabled"),
    ("C2", "PARSE_JSON", "TASK", "Enabled by Default"),
    ("C3", "GEOGRAPHY", "VIEW", "Disabled by Default"),
    ("C4", "UNKNOWN_THING", "STREAM", "Enabled by Default"),
    ("C5", "SEARCH_PREVIEW", "NONE", "Disabled by Default"),
]


def _changes(spark):
    return spark.createDataFrame(CHANGES, "change_id string, keyword string, category_type string, lifecycle string")


def _impact(t):
    changes = _changes(t.spark)
    objects = t.query_log.select(
        F.concat(F.lit("OBJ_"), F.col("query_id").cast("string")).alias("object_name"),
        F.when(F.col("query_type") == "SELECT", "VIEW").otherwise("TASK").alias("object_type"),
        F.col("query_text").alias("definition"),
    )
    usage = (
        t.query_log.filter(spark_since("start_time", AS_OF, ALL_DAYS))
        .select(F.regexp_extract("query_text", "(FLATTEN|SEARCH_PREVIEW)", 1).alias("keyword"))
        .groupBy("keyword")
        .agg(F.count(F.lit(1)).alias("executions"))
    )
    return H.change_impact(changes, objects, usage)


_CHANGES = "changes AS (SELECT * FROM (VALUES " + ", ".join(
    "('" + "', '".join(c) + "')" for c in CHANGES
) + ") v(change_id, keyword, category_type, lifecycle))"
_IMPACT = f"""{_CHANGES}, obj AS (SELECT 'OBJ_' || CAST(query_id AS VARCHAR) AS o, CASE WHEN query_type = 'SELECT' THEN 'VIEW' ELSE 'TASK' END AS ty, query_text AS d, start_time FROM query_log),
  hits AS (SELECT change_id, o, 2 AS s, 'definition holds ' || keyword AS evidence FROM obj JOIN changes ON contains(upper(d), upper(keyword))
    UNION ALL SELECT change_id, o, 1, 'feature area ' || category_type FROM obj JOIN changes ON ty = category_type
    UNION ALL SELECT change_id, NULL, 1, 'query history' FROM changes WHERE keyword IN (SELECT regexp_extract(d, '(FLATTEN|SEARCH_PREVIEW)', 1) FROM obj WHERE {since("start_time")})),
  g AS (SELECT change_id, max(s) AS s, count(DISTINCT o) AS n, string_agg(DISTINCT evidence, '; ' ORDER BY evidence) AS evidence FROM hits GROUP BY 1),
  impact AS (SELECT c.change_id, CASE WHEN s = 2 THEN 'CRITICAL' WHEN s = 1 THEN 'WARNING' ELSE 'INFO' END AS severity,
    coalesce(n, 0) AS affected_objects, coalesce(evidence, '') AS evidence FROM changes c LEFT JOIN g USING (change_id))"""


@query("change_impact", f"WITH {_IMPACT} SELECT * FROM impact", ("query_log",))
def _(t):
    return _impact(t)


@query(
    "remediation_priority",
    f"""
    WITH {_IMPACT}, p AS (SELECT change_id, severity, lifecycle, CASE
        WHEN severity = 'CRITICAL' AND lifecycle = 'Disabled by Default' THEN 'HIGH' WHEN severity = 'CRITICAL' THEN 'URGENT'
        WHEN severity = 'WARNING' AND lifecycle = 'Disabled by Default' THEN 'MEDIUM' WHEN severity = 'WARNING' AND lifecycle = 'Enabled by Default' THEN 'HIGH'
        WHEN severity = 'WARNING' THEN 'URGENT' ELSE 'NONE' END AS priority FROM impact JOIN changes USING (change_id))
    SELECT *, CASE priority WHEN 'URGENT' THEN 'within 1 week' WHEN 'HIGH' THEN 'within 2-4 weeks' WHEN 'MEDIUM' THEN 'within 1-2 months' ELSE 'no action' END AS action_window FROM p
    """,
    ("query_log",),
)
def _(t):
    impact = _impact(t).select("change_id", "severity").join(_changes(t.spark).select("change_id", "lifecycle"), "change_id")
    return H.remediation_priority(impact)


def _rules(t):
    """Rules of the part tree; those of one kind are missing."""
    return t.table("part").filter("p_size <> 50").select(F.col("p_partkey").alias("node"))


@query(
    "resolve_dependencies",
    """
    WITH RECURSIVE r AS (SELECT p_partkey AS node FROM part WHERE p_size <> 50),
    dep AS (SELECT child, parent FROM edges WHERE child IN (SELECT node FROM r)),
    b AS (SELECT child, min(parent) AS missing FROM dep WHERE parent NOT IN (SELECT node FROM r) GROUP BY 1),
    walk AS (SELECT child AS start, child AS node, CAST(0 AS BIGINT) AS depth FROM b
             UNION ALL SELECT w.start, d.child, w.depth + 1 FROM walk w JOIN dep d ON d.parent = w.node),
    x AS (SELECT node, min(struct_pack(depth := depth, missing := missing)) AS m FROM walk JOIN b ON b.child = walk.start GROUP BY 1)
    SELECT node, m IS NULL AS is_kept, m.missing AS missing,
      CASE WHEN m IS NULL THEN 'OK' WHEN m.depth = 0 THEN 'MISSING_DEPENDENCY' ELSE 'DEPENDS_ON_DROPPED' END AS status
    FROM r LEFT JOIN x USING (node)
    """,
    ("edges",),
)
def _(t):
    rules = _rules(t)
    depends = t.edges.join(as_large(rules.withColumnRenamed("node", "child")), "child", "left_semi")
    return C.resolve_dependencies(rules, depends)


@query(
    "load_order",
    """
    WITH RECURSIVE walk AS (SELECT p_partkey AS node, CAST(0 AS BIGINT) AS level FROM part
      UNION SELECT e.child, w.level + 1 FROM walk w JOIN edges e ON e.parent = w.node)
    SELECT node, max(level) AS level FROM walk GROUP BY 1
    """,
    ("edges",),
)
def _(t):
    return C.load_order(t.table("part").select(F.col("p_partkey").alias("node")), t.edges)
