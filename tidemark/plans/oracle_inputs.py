"""The canonical input relations once more, in SQL for the check engine."""

from __future__ import annotations

from tidemark.plans import inputs as I


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values: list[str], index: str) -> str:
    return f"{_list(values)}[CAST(({index}) % {len(values)} AS INT) + 1]"


def database_of(k: str) -> str:
    return pick(I.DATABASES, k)


def schema_of(k: str) -> str:
    return pick(I.SCHEMAS, k)


def table_of(k: str) -> str:
    return f"({pick(I.PREFIXES, k)} || {pick(I.WORDS, k)} || CAST({k} AS VARCHAR))"


def full_name(k: str) -> str:
    return f"({database_of(k)} || '.' || {schema_of(k)} || '.' || {table_of(k)})"


_QUERY_LOG = f"""
SELECT o_orderkey AS query_id, 'U' || CAST(o_custkey % 50 AS VARCHAR) AS user_name,
  replace(replace(replace(replace(replace(replace({pick(I.TEMPLATES, "o_orderkey")},
    '{{t1}}', t1), '{{t2}}', t2), '{{t3}}', t3), '{{short}}', db1 || '..' || tb1), '{{bare}}', tb1),
    '{{n}}', CAST(o_custkey % 30 AS VARCHAR)) AS query_text,
  o_orderdate AS start_time,
  CASE WHEN o_orderstatus = 'F' THEN 'FAIL' ELSE 'SUCCESS' END AS status,
  db1 AS database_name, o_totalprice AS elapsed_ms,
  {pick(I.QUERY_TYPES, "o_orderkey")} AS query_type,
  {pick(I.DOMAINS, "o_custkey")} AS domain,
  CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE 'What is the total by region for group ' || CAST(o_custkey % 50 AS VARCHAR) || '?' END AS question
FROM (SELECT *, {full_name("k1")} AS t1, {full_name("k2")} AS t2, {full_name("k3")} AS t3,
             {database_of("k1")} AS db1, {table_of("k1")} AS tb1
      FROM (SELECT *, o_custkey % {I.N_SHARED_OBJECTS} AS k1, (o_custkey * 7 + 3) % {I.N_SHARED_OBJECTS} AS k2,
                   (o_custkey * 11 + 5) % {I.N_SHARED_OBJECTS} AS k3 FROM orders))
"""

_ACCESS = f"""
SELECT o_orderkey AS query_id, 'U' || CAST(o_custkey % 50 AS VARCHAR) AS user_name, o_orderdate AS ts,
       {full_name("k")} AS object_name,
       CASE WHEN k % 25 = 9 THEN 'Stage' WHEN k % 10 = 3 THEN 'View' ELSE 'Table' END AS object_domain
FROM (SELECT *, l_partkey % {I.N_SHARED_OBJECTS} AS k FROM lineitem) JOIN orders ON l_orderkey = o_orderkey
"""

_TABLES = f"""
SELECT {database_of("p_partkey")} AS database_name, {schema_of("p_partkey")} AS schema_name,
       {table_of("p_partkey")} AS table_name,
       CASE WHEN p_size % 10 = 3 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type,
       rows AS row_count, rows * (p_size + 7) AS bytes, rows * (p_size % 4) AS retained_bytes,
       CASE WHEN p_type NOT IN ('ECONOMY', 'PROMO') THEN p_name END AS comment,
       TIMESTAMP '{I.AS_OF}' - to_days(CAST(p_size * 20 + p_partkey % 500 AS INT)) AS created,
       TIMESTAMP '{I.AS_OF}' - to_days(CAST(p_size * p_size % 400 AS INT)) AS last_altered,
       'ROLE_' || replace(p_brand, 'Brand#', '') AS owner, p_partkey AS part_key, CAST(p_size AS BIGINT) AS size_code
FROM (SELECT *, CAST(CASE WHEN p_size <= 2 THEN 0 ELSE floor(p_retailprice * p_size * 1000) END AS BIGINT) AS rows FROM part)
"""


PARENT = "((k // 16) * 8 + k % 8)"

_CONSTRAINTS = f"""
SELECT {database_of("k")} AS database_name, {schema_of("k")} AS schema_name, {table_of("k")} AS table_name,
       'FK_' || CAST(k AS VARCHAR) AS constraint_name, 'FOREIGN KEY' AS constraint_type,
       {table_of(PARENT)} || '_ID' AS column_name, {table_of(PARENT)} AS ref_table, 'ID' AS ref_column
FROM (SELECT p_partkey AS k FROM part WHERE p_type = 'LARGE') WHERE k <> {PARENT}
"""

_CONCEPTS = f"""
SELECT 'C' || CAST(part_key AS VARCHAR) AS concept_id, database_name, schema_name, table_name,
       database_name || '.' || schema_name || '.' || table_name AS full_name,
       regexp_replace(database_name, '(_DB|_DW|_PROD|_DEV|_STAGE|_STG)$', '') AS domain, comment AS description,
       list_transform(range(1, size_code % 5 + 2), lambda i: 'kw' || CAST((i * 7 + part_key) % 30 AS VARCHAR)) AS keywords,
       size_code % 4 > 0 AS has_joins, size_code % 3 > 0 AS has_metrics, size_code % 2 > 0 AS has_samples,
       round((size_code * 7 % 100) / 100.0, 2)::DOUBLE AS quality_score, size_code % 4 AS tier,
       TIMESTAMP '{I.AS_OF}' - to_days(CAST(size_code * 3 % 200 AS INT)) AS enriched_at, size_code <> 5 AS is_active,
       part_key * 31 % 37 AS usage_count, row_count, last_altered, part_key, size_code
FROM catalog_tables WHERE part_key IN (SELECT p_partkey FROM part WHERE p_type <> 'STANDARD')
"""

_QUESTION_LOG = f"""
SELECT conv_id * 1000 + turn AS question_id, text AS question,
       TIMESTAMP '{I.EVENTS_AS_OF}' - to_days(CAST(conv_id % 120 AS INT)) AS asked_at,
       CASE WHEN n % 7 = 0 THEN 'ERROR' WHEN n % 11 = 0 THEN 'EMPTY' ELSE 'OK' END AS status,
       CASE WHEN n % 7 = 0 THEN {pick(I.MESSAGES, "n")} END AS error_message, n % 3 <> 0 AS helpful,
       list_distinct(['C' || CAST(conv_id % 40 AS VARCHAR), 'C' || CAST((conv_id + turn) % 40 AS VARCHAR)]) AS concepts_used
FROM (SELECT *, length(text) AS n FROM conversations WHERE role = 'user')
"""


def _columns(newer: bool) -> str:
    extra = "CASE WHEN size IN (11, 22, 33, 44) THEN 1 ELSE 0 END" if newer else "0"
    keep = "WHERE p_size NOT IN (17, 34)" if newer else ""
    kind = "CASE WHEN size IN (13, 26, 39) AND i = 3 THEN 'VARIANT' ELSE kind0 END" if newer else "kind0"
    precision = "CASE WHEN size = 9 THEN 38 ELSE 18 END" if newer else "18"
    length = "CASE WHEN size = 10 THEN 256 ELSE 64 END" if newer else "64"
    return f"""
SELECT {database_of("k")} AS database_name, {schema_of("k")} AS schema_name, {table_of("k")} AS table_name,
       nm AS column_name, {kind} AS data_type,
       CAST(CASE WHEN kind0 = 'NUMBER' THEN {precision} END AS BIGINT) AS numeric_precision,
       CAST(CASE WHEN kind0 = 'VARCHAR' THEN {length} END AS BIGINT) AS char_length,
       (i % 3 <> 1) AS nullable,
       CASE WHEN (k + i) % 4 = 0 THEN 'Holds ' || lower(nm) END AS comment, CAST(i AS BIGINT) AS ordinal
FROM (SELECT *, CASE WHEN i = 1 THEN 'ID' WHEN i = 2 THEN {table_of(PARENT)} || '_ID'
                     ELSE {pick(I.COLUMNS, "k * 3 + i * 5")} END AS nm,
             CASE WHEN i <= 2 THEN 'NUMBER' ELSE {pick(I.TYPES, "k * 3 + i * 5")} END AS kind0
      FROM (SELECT k, size, unnest(range(1, n + 1)) AS i
            FROM (SELECT k, size, 2 + size % 8 + {extra} AS n
                  FROM (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS size FROM part {keep}))))
"""


_EDGES = """
SELECT DISTINCT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 0
UNION
SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0 AND p_type = 'PROMO'
"""

_RUNS = f"""
SELECT event_id AS run_id, 'JOB_' || CAST(user_id AS VARCHAR) AS object_name,
       CASE WHEN user_id % 2 = 0 THEN 'TASK' ELSE 'DERIVED_TABLE' END AS object_type,
       CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS state, ts,
       CASE WHEN event_type = 'error' THEN {pick(I.MESSAGES, "event_id * 5 + user_id")} END AS message, value, user_id
FROM events
"""

_FAILURES = f"""
SELECT event_id AS failure_id, 'JOB_' || CAST(user_id AS VARCHAR) AS object_name,
       CASE WHEN user_id % 2 = 0 THEN 'TASK' ELSE 'DERIVED_TABLE' END AS object_type, ts AS detected_at,
       {pick(I.MESSAGES, "event_id * 5 + user_id")} AS error_message,
       {pick(["RESOLVED", "ESCALATED", "PENDING_REVIEW", "NEW"], "event_id * 7 + user_id")} AS status,
       (event_id * 3 + user_id) % 5 AS fix_attempts, user_id AS node
FROM events WHERE event_type = 'error'
"""

_AUDIT = f"""
SELECT event_id AS log_id, user_id AS failure_id, {pick(["DIAGNOSE", "DIAGNOSE_DT", "EXECUTE", "VERIFY"], "event_id")} AS action_type,
       {pick(["RUNBOOK", "model-a", "model-b"], "event_id + user_id")} AS model_used,
       {pick(["PASS", "REVIEW:LOW_CONFIDENCE", "BLOCK:BLOCKED_OPERATION"], "event_id * 5 + user_id")} AS guardrail_result,
       round((value % 100.0) / 100, 2) AS confidence, ts AS created_at
FROM events
"""

_TIMING = f"""
SELECT substr(md5(CAST(event_id AS VARCHAR)), 1, 16) AS run_id, {pick(I.SKILLS, "event_id")} AS skill_name,
       {pick(I.RUN_MODES, "user_id")} AS mode, {pick(I.MODELS, "(user_id % 7)")} AS model, ts AS started,
       value AS duration_seconds, event_id % 5000 AS input_tokens, event_id % 700 AS output_tokens, user_id
FROM events
"""

_SCORES = f"""
SELECT event_id AS score_id, user_id % 40 AS input_id,
       {pick(["answer_correctness", "logical_consistency", "tool_selection_accuracy"], "event_id")} AS metric,
       {pick(["baseline", "tuned", "wide"], "event_id // 3")} AS variant,
       (event_id // 9) % 5 + 1 AS run, CASE WHEN user_id % 20 < 9 THEN 'DEV' ELSE 'TEST' END AS split,
       (event_id // 45) % 4 AS iteration, round((value % 100.0) / 100, 4) AS score,
       CASE WHEN event_type = 'signup' THEN 'revalidation' ELSE 'sweep' END AS source,
       (event_type = 'error') AS is_error
FROM events
"""

_QUESTIONS = f"""
SELECT item_id AS test_id,
       {pick(["lookup", "trend", "compare", "rank", "explain", "forecast"], "item_id * item_id")} AS test_category,
       text AS input_query,
       CASE item_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '{{}}' WHEN 2 THEN '{{"ground_truth_output": " "}}'
            ELSE '{{"ground_truth_output": "answer ' || CAST(item_id AS VARCHAR) || '"}}' END AS ground_truth,
       CASE WHEN item_id % 9 < 4 THEN 'DEV' ELSE 'TEST' END AS split
FROM benchmark
"""

RELATIONS = {
    "query_log": _QUERY_LOG,
    "access": _ACCESS,  # one row per query and object, unlike the nested Spark form
    "catalog_tables": _TABLES,
    "catalog_columns": _columns(False),
    "catalog_columns_new": _columns(True),
    "constraints": _CONSTRAINTS,
    "current_tables": "SELECT * FROM catalog_tables WHERE size_code NOT IN (17, 34)",
    "concepts": _CONCEPTS,
    "question_log": _QUESTION_LOG,
    "edges": _EDGES,
    "run_history": _RUNS,
    "failures": _FAILURES,
    "audit_log": _AUDIT,
    "timing_runs": _TIMING,
    "eval_scores": _SCORES,
    "eval_questions": _QUESTIONS,
}


def half_up(sql: str) -> str:
    """Let every round(x, n) work on decimals: exact halves go up, as they do in Spark."""
    out, at = [], 0
    while True:
        start = sql.find("round(", at)
        if start < 0:
            return "".join(out) + sql[at:]
        depth, comma, end = 1, None, start + 6
        quoted = False
        while depth:
            c = sql[end]
            if c == "'":
                quoted = not quoted
            elif not quoted and c in "([":
                depth += 1
            elif not quoted and c in ")]":
                depth -= 1
            elif not quoted and c == "," and depth == 1:
                comma = end
            end += 1
        out.append(sql[at:start])
        inner = sql[start + 6 : end - 1]
        if comma is None:
            out.append(f"round({half_up(inner)})")
        else:
            value, digits = sql[start + 6 : comma], sql[comma + 1 : end - 1]
            out.append(f"CAST(round(CAST({half_up(value)} AS DECIMAL(38, 12)), {digits.strip()}) AS DOUBLE)")
        at = end


def with_inputs(uses: tuple[str, ...], sql: str) -> str:
    """Prefix a check with the relations it reads."""
    body = half_up(sql.strip())
    head = ",\n".join(f"{name} AS ({half_up(RELATIONS[name])})" for name in uses)
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {head},\n{body[len('WITH'):]}"
    return f"WITH {head}\n{body}"
