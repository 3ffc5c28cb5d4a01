"""Query-log mining queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.sqltext import normalize_table, normalized_text
from tidemark.operators import sqlmining as X
from tidemark.plans.inputs import AS_OF
from tidemark.plans.q_usage import ALL_DAYS, since
from tidemark.plans.registry import query

CLEAN = (
    "regexp_replace(regexp_replace(regexp_replace(query_text, '(?m)--.*?$', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'),"
    " '(?m)//.*?$', '', 'g')"
)
IS_WRITE = (
    f"(regexp_matches(upper(trim({CLEAN})), '(?m)^\\s*(UPDATE|DELETE|INSERT|DROP|ALTER|TRUNCATE|MERGE)\\s+') OR "
    f"regexp_matches(upper(trim({CLEAN})), 'CREATE\\s+(OR\\s+REPLACE\\s+)?(TEMP|TEMPORARY|VOLATILE)?\\s*TABLE\\s+'))"
)
_SKIP = (
    "'SELECT','WHERE','AND','OR','ON','GROUP','ORDER','HAVING','LIMIT','UNION','CASE','WHEN','THEN','ELSE','END','AS',"
    "'LEFT','RIGHT','INNER','OUTER','CROSS','FULL','LATERAL','WITH','RECURSIVE','NOT','NULL','TRUE','FALSE','IN','EXISTS'"
)
_NORMAL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(query_text, '''[^'']*''', '?', 'g'), "
    "'\\b\\d+(\\.\\d+)?\\b', '?', 'g'), '\\s+', ' ', 'g'))"
)
_THREE = "[A-Za-z0-9_$]+\\.[A-Za-z0-9_$]+\\.[A-Za-z0-9_$]+"

# one row per query and table of a query that is no write
TABLES = f"""
  clean AS (SELECT *, {CLEAN} AS txt, {IS_WRITE} AS w FROM query_log),
  names AS (SELECT query_id, domain, upper(replace(trim(n), '"', '')) AS n FROM (
     SELECT query_id, domain,
       unnest(regexp_extract_all(txt, '(?i)(?:FROM|JOIN)\\s+(["\\w]+(?:\\.\\.?["\\w]+)*)\\s*(?:AS\\s+)?', 1)) AS n
     FROM clean WHERE NOT w)),
  qt AS (SELECT DISTINCT query_id, CASE WHEN coalesce(domain, '') = '' THEN 'Unknown' ELSE domain END AS domain,
     CASE WHEN len(string_split(n, '..')) = 2 THEN split_part(n, '..', 1) || '.PUBLIC.' || split_part(n, '..', 2) ELSE n END AS t
     FROM names),
  used AS (SELECT *, string_split(t, '.')[-1] AS last FROM qt),
  tabs AS (SELECT query_id, domain, t,
     CASE WHEN last LIKE 'DIM\\_%' ESCAPE '\\' THEN 'dimension' WHEN last LIKE 'FCT\\_%' ESCAPE '\\' THEN 'fact' ELSE 'other' END AS cls
     FROM used WHERE last NOT IN ({_SKIP}) AND NOT regexp_matches(last, '^\\d+$')
       AND NOT (starts_with(last, 'PA') AND length(last) <= 5))
"""
_COLUMNS = f"""
  clean AS (SELECT *, {CLEAN} AS txt, {IS_WRITE} AS w FROM query_log),
  cols AS (SELECT DISTINCT query_id, upper(a) AS alias, upper(c) AS name FROM (
     SELECT query_id, unnest(regexp_extract_all(txt, '["'']?([A-Za-z_][A-Za-z0-9_]*)["'']?\\s*\\.\\s*["'']?([A-Za-z_][A-Za-z0-9_]*)["'']?', 1)) AS a,
       unnest(regexp_extract_all(txt, '["'']?([A-Za-z_][A-Za-z0-9_]*)["'']?\\s*\\.\\s*["'']?([A-Za-z_][A-Za-z0-9_]*)["'']?', 2)) AS c
     FROM clean WHERE NOT w)
     WHERE upper(c) NOT IN ('PUBLIC', 'DBO', 'SCHEMA', 'FCT', 'DIM', 'ALL') AND NOT starts_with(upper(c), 'PS_PRD'))
"""
_PATTERNS = f"""
  pats AS (SELECT sha256({_NORMAL}) AS pattern_hash, arg_min(query_text, query_id) AS query_text,
     min(user_name) AS sample_user, count(*) AS execution_count, count(DISTINCT user_name) AS distinct_users,
     min(start_time) AS first_seen, max(start_time) AS last_seen
     FROM query_log WHERE {since("start_time")} GROUP BY 1
     HAVING length(arg_min(query_text, query_id)) > 50
       AND upper(arg_min(query_text, query_id)) LIKE '%SELECT%')
"""
_DOMAIN_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower(tt), '{w}') THEN '{n}'" for n, w in X.DOMAIN_WORDS) + " ELSE 'OTHER' END"


def _patterns(t):
    return X.query_patterns(t.query_log, AS_OF, ALL_DAYS, top=None)


def _processed(t):
    return X.process_queries(t.query_log)


@query("strip_comments", f"SELECT query_id, {CLEAN} AS clean_text, {IS_WRITE} AS is_write FROM query_log", ("query_log",))
def _(t):
    return X.write_filter(t.query_log)


@query(
    "is_write",
    f"SELECT query_type, {IS_WRITE} AS is_write, count(*) AS query_count FROM query_log GROUP BY 1, 2",
    ("query_log",),
)
def _(t):
    return (
        X.write_filter(t.query_log)
        .join(t.query_log.select("query_id", "query_type"), "query_id")
        .groupBy("query_type", "is_write")
        .agg(F.count(F.lit(1)).alias("query_count"))
    )


@query(
    "process_queries",
    f"""
    WITH {TABLES},
    cl AS (SELECT query_id, string_agg(alias || '.' || name, ',' ORDER BY alias, name) AS cs FROM (
      WITH {_COLUMNS} SELECT * FROM cols) GROUP BY 1),
    tl AS (SELECT query_id, string_agg(t, ',' ORDER BY t) AS ts FROM tabs GROUP BY 1)
    SELECT c.query_id AS index, w AS skipped, CASE WHEN w THEN 'DML/DDL operation detected' END AS reason,
           coalesce(ts, '') AS tables, coalesce(cs, '') AS columns
    FROM clean c LEFT JOIN tl ON tl.query_id = c.query_id LEFT JOIN cl ON cl.query_id = c.query_id
    """,
    ("query_log",),
)
def _(t):
    pairs = F.transform("columns", lambda c: F.concat_ws(".", c["alias"], c["name"]))
    return _processed(t).select(
        "index", "skipped", "reason", F.array_join("tables", ",").alias("tables"), F.array_join(pairs, ",").alias("columns")
    )


@query(
    "extract_columns",
    f"""
    WITH {_COLUMNS}
    SELECT query_id AS index, alias, string_agg(name, ',' ORDER BY name) AS columns FROM cols GROUP BY 1, 2
    """,
    ("query_log",),
)
def _(t):
    return X.query_columns(_processed(t))


@query(
    "extract_tables",
    f"WITH {TABLES} SELECT t AS table_name, query_id AS query_index, cls AS table_class FROM tabs",
    ("query_log",),
)
def _(t):
    return X.table_usage(_processed(t))


@query(
    "consolidate_tables",
    f"""
    WITH {TABLES}
    SELECT t AS table_name, cls AS table_class, count(*) AS used_in_queries, min(query_id) AS first_query,
           max(query_id) AS last_query FROM tabs GROUP BY 1, 2
    """,
    ("query_log",),
)
def _(t):
    return X.consolidate_tables(_processed(t))


@query(
    "extraction_summary",
    f"""
    WITH {TABLES}, u AS (SELECT DISTINCT t, cls FROM tabs)
    SELECT (SELECT count(*) FROM clean) AS total_queries, (SELECT count(*) FROM clean WHERE NOT w) AS processed,
           (SELECT count(*) FROM clean WHERE w) AS skipped, count(*) AS unique_tables,
           count(*) FILTER (cls = 'dimension') AS dimension_tables, count(*) FILTER (cls = 'fact') AS fact_tables,
           count(*) FILTER (cls = 'other') AS other_tables
    FROM u
    """,
    ("query_log",),
)
def _(t):
    return X.extraction_summary(_processed(t))


@query(
    "domain_usage",
    f"""
    WITH {TABLES}, q AS (SELECT CASE WHEN coalesce(domain, '') = '' THEN 'Unknown' ELSE domain END AS domain, count(*) AS n
                         FROM clean WHERE NOT w GROUP BY 1)
    SELECT q.domain, q.n AS query_count, (SELECT count(DISTINCT t) FROM tabs WHERE tabs.domain = q.domain) AS table_count FROM q
    """,
    ("query_log",),
)
def _(t):
    return X.domain_usage(_processed(t))


@query(
    "shared_tables",
    f"""
    WITH {TABLES}
    SELECT t AS table_name, count(DISTINCT domain) AS domain_count, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains
    FROM tabs GROUP BY 1 HAVING count(DISTINCT domain) > 1
    """,
    ("query_log",),
)
def _(t):
    return X.shared_tables(_processed(t))


@query(
    "domain_tables",
    f"WITH {TABLES} SELECT domain, t AS table_name, count(DISTINCT query_id) AS query_count FROM tabs GROUP BY 1, 2",
    ("query_log",),
)
def _(t):
    return X.domain_tables(_processed(t))


@query(
    "shared_table_queries",
    f"""
    WITH {TABLES}, s AS (SELECT t FROM tabs GROUP BY 1 HAVING count(DISTINCT domain) > 1)
    SELECT DISTINCT t AS table_name, domain, query_id AS query_index FROM tabs WHERE t IN (SELECT t FROM s)
    """,
    ("query_log",),
)
def _(t):
    return X.shared_table_queries(_processed(t))


_AGG = "(?i)(SUM|COUNT|AVG|MIN|MAX|MEDIAN|STDDEV|VARIANCE)\\s*\\(\\s*(DISTINCT\\s+)?([^)]+)\\)"


@query(
    "mine_metrics",
    f"""
    WITH c AS (SELECT CASE WHEN coalesce(domain, '') = '' THEN 'Unknown' ELSE domain END AS domain,
                 question,
                 unnest(regexp_extract_all(query_text, '{_AGG}', 1)) AS func,
                 unnest(regexp_extract_all(query_text, '{_AGG}', 2)) AS dist,
                 trim(unnest(regexp_extract_all(query_text, '{_AGG}', 3))) AS arg FROM query_log),
    m AS (SELECT domain, question,
            lower(func) || CASE WHEN arg IN ('*', '1') THEN '_all'
              ELSE '_' || lower(regexp_extract(arg, '([a-zA-Z_][a-zA-Z0-9_]*)\\s*$', 1)) END AS metric_name,
            upper(func) || '(' || CASE WHEN coalesce(dist, '') <> '' THEN 'DISTINCT ' ELSE '' END || arg || ')' AS expr
          FROM c WHERE (arg IN ('*', '1') OR regexp_extract(arg, '([a-zA-Z_][a-zA-Z0-9_]*)\\s*$', 1) <> '')),
    e AS (SELECT domain, metric_name, expr, count(*) AS n FROM m GROUP BY 1, 2, 3),
    best AS (SELECT domain, metric_name, expr FROM e
             QUALIFY row_number() OVER (PARTITION BY domain, metric_name ORDER BY n DESC, expr) = 1),
    s AS (SELECT domain, metric_name, string_agg(question, ' | ' ORDER BY question) AS sample_questions FROM (
            SELECT DISTINCT domain, metric_name, question FROM m
            QUALIFY dense_rank() OVER (PARTITION BY domain, metric_name ORDER BY question) <= 3) GROUP BY 1, 2)
    SELECT b.domain, b.metric_name, b.expr, CAST(sum(e.n) AS BIGINT) AS usage_count, any_value(s.sample_questions) AS sample_questions
    FROM best b JOIN e ON e.domain = b.domain AND e.metric_name = b.metric_name
    JOIN s ON s.domain = b.domain AND s.metric_name = b.metric_name GROUP BY 1, 2, 3
    """,
    ("query_log",),
)
def _(t):
    return X.mine_metrics(t.query_log)


@query(
    "aggregated_columns",
    """
    SELECT aggregated_column, count(*) AS frequency FROM (
      SELECT upper(trim(regexp_extract(query_text, '(?i)(?:SUM|COUNT|AVG|MIN|MAX)\\s*\\(\\s*([^)]+)\\)', 1))) AS aggregated_column
      FROM query_log) WHERE aggregated_column <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50
    """,
    ("query_log",),
)
def _(t):
    return X.aggregated_columns(t.query_log)


@query(
    "verified_queries",
    """
    SELECT domain, 'vqr_' || CAST(query_id AS VARCHAR) AS name, question, query_text AS sql,
           rn <= 5 AS use_as_onboarding_question
    FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY query_id) AS rn FROM (
            SELECT * REPLACE (CASE WHEN coalesce(domain, '') = '' THEN 'Unknown' ELSE domain END AS domain) FROM query_log)
          WHERE question <> '' AND query_text <> '' AND NOT regexp_matches(upper(query_text), 'CREATE|UPDATE|DELETE'))
    """,
    ("query_log",),
)
def _(t):
    return X.verified_queries(t.query_log)


_KNOWN = "DIM_|FCT_"


@query(
    "candidate_tables",
    f"""
    WITH b AS (SELECT * FROM query_log WHERE {since("start_time")} AND status = 'SUCCESS'
                 AND regexp_matches(upper(query_text), '{_KNOWN}')),
    r AS (SELECT query_id, user_name, upper(unnest(regexp_extract_all(query_text,
            '(?i)(?:FROM|JOIN)\\s+(?:[A-Z0-9_$]+\\.){{0,2}}([A-Z0-9_$]+)', 1))) AS candidate_table FROM b)
    SELECT candidate_table, count(DISTINCT query_id) AS query_count, count(DISTINCT user_name) AS unique_users,
      round(count(DISTINCT query_id) * 100.0::DOUBLE / (SELECT count(DISTINCT query_id) FROM b), 1) AS pct_of_queries
    FROM r WHERE length(candidate_table) > 3 AND NOT regexp_matches(candidate_table, '{_KNOWN}')
      AND candidate_table NOT IN ('SELECT','WHERE','FROM','JOIN','ON','AND','OR','AS','NULL')
    GROUP BY 1 HAVING count(DISTINCT query_id) >= 5 ORDER BY 2 DESC, 1 LIMIT 15
    """,
    ("query_log",),
)
def _(t):
    return X.candidate_tables(t.query_log, _KNOWN, AS_OF, ALL_DAYS)


@query(
    "candidate_columns",
    f"""
    WITH b AS (SELECT *, upper(query_text) AS u FROM query_log WHERE {since("start_time")} AND status = 'SUCCESS'
                 AND regexp_matches(upper(query_text), '{_KNOWN}')),
    r AS (SELECT DISTINCT query_id, user_name, u, upper(unnest(regexp_extract_all(query_text,
            '(?i)(?:WHERE|AND|OR|GROUP BY|ORDER BY|SELECT)[\\s,]+([A-Z_][A-Z0-9_]+)', 1))) AS candidate_col FROM b),
    x AS (SELECT *, CASE WHEN u LIKE '%WHERE%' || replace(candidate_col, '_', '\\_') || '%' ESCAPE '\\'
                      OR u LIKE '%AND%' || replace(candidate_col, '_', '\\_') || '%' ESCAPE '\\' THEN 'filter'
                    WHEN u LIKE '%GROUP BY%' || replace(candidate_col, '_', '\\_') || '%' ESCAPE '\\' THEN 'group_by'
                    ELSE 'select' END AS c
          FROM r WHERE length(candidate_col) > 3 AND candidate_col <> 'STATUS_CODE' AND candidate_col NOT IN
            ('FROM','WHERE','JOIN','NULL','TRUE','FALSE','CASE','WHEN','THEN','ELSE','END','LIMIT'))
    SELECT candidate_col, count(DISTINCT query_id) AS query_count, count(DISTINCT user_name) AS unique_users,
           string_agg(DISTINCT c, ', ' ORDER BY c) AS usage_contexts
    FROM x GROUP BY 1 HAVING count(DISTINCT query_id) >= 3 ORDER BY 2 DESC, 1 LIMIT 20
    """,
    ("query_log",),
)
def _(t):
    return X.candidate_columns(t.query_log, _KNOWN, ["STATUS_CODE"], AS_OF, ALL_DAYS)


@query(
    "search_filter_columns",
    f"""
    SELECT filter_col, count(*) AS usage_count, CASE WHEN count(*) >= 5 THEN 'ADD' ELSE 'REVIEW' END AS recommendation
    FROM (SELECT upper(unnest(regexp_extract_all(query_text, '(?is)FILTER.*?([A-Z_]+)\\s*=', 1))) AS filter_col
          FROM query_log WHERE {since("start_time")} AND status = 'SUCCESS' AND upper(query_text) LIKE '%SEARCH\\_PREVIEW%' ESCAPE '\\')
    WHERE filter_col NOT IN ('CATEGORY') GROUP BY 1 HAVING count(*) >= 2
    """,
    ("query_log",),
)
def _(t):
    return X.search_filter_columns(t.query_log, ["CATEGORY"], AS_OF, ALL_DAYS)


@query(
    "query_patterns",
    f"WITH {_PATTERNS} SELECT * FROM pats ORDER BY execution_count DESC, pattern_hash LIMIT 30",
    ("query_log",),
)
def _(t):
    return X.query_patterns(t.query_log, AS_OF, ALL_DAYS)


_NOISE = (
    "(?s)ATTREP_CHANGES|REPLICATE_OP|INFORMATION_SCHEMA\\.(DATABASES|COLUMNS)|SYSTEM\\$(AUTHORIZE|BOOTSTRAP)"
    "|_STAGE_STREAM.*LATERAL FLATTEN"
)


@query(
    "drop_noise",
    f"""
    WITH {_PATTERNS}
    SELECT pattern_hash, execution_count, distinct_users FROM pats
    WHERE NOT regexp_matches(upper(query_text), '{_NOISE}')
      AND NOT regexp_matches(upper(query_text), '^\\s*(INSERT\\s+INTO|DELETE\\s+FROM|MERGE\\s+INTO)')
      AND ((regexp_matches(upper(query_text), '^\\s*SELECT') AND regexp_matches(upper(query_text),
        '\\bJOIN\\b|GROUP\\s+BY|\\b(SUM|COUNT|AVG|MIN|MAX)\\s*\\(|CASE\\s+WHEN|OVER\\s*\\(')) OR distinct_users >= 3)
    """,
    ("query_log",),
)
def _(t):
    return X.drop_noise(_patterns(t)).select("pattern_hash", "execution_count", "distinct_users")


def _found(pattern: str, group: int = 1) -> str:
    return (
        f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(query_text, '{pattern}', {group}), "
        "lambda x: upper(x)))), ',')"
    )


@query(
    "pattern_features",
    f"""
    WITH {_PATTERNS}
    SELECT pattern_hash, {_found("(" + _THREE + ")")} AS tables,
      {_found("(?i)(?:WHERE|AND)\\s+([A-Z_][A-Z0-9_.]*)\\s*(?:=|>|<|IS|IN|LIKE)")} AS filter_columns,
      {_found("(?i)((?:SUM|COUNT|AVG|MIN|MAX)\\s*\\([^)]*\\))")} AS aggregates,
      {_found("(?i)GROUP\\s+BY\\s+([A-Z0-9_.]+)")} AS group_by,
      len(regexp_extract_all(query_text, '(?i)CASE\\s+WHEN')) AS case_count,
      {_found("(?i)\\)\\s+AS\\s+([A-Z_][A-Z0-9_]*)")} AS aliases,
      {_found("(?i)(?:WITH|,)\\s+([A-Z_][A-Z0-9_]*)\\s+AS\\s*\\(")} AS ctes
    FROM pats
    """,
    ("query_log",),
)
def _(t):
    return X.pattern_features(_patterns(t))


_HEAT = f"""
  heat AS (SELECT {_DOMAIN_CASE} AS business_domain, count(*) AS pattern_count, max(distinct_users) AS max_users
     FROM (SELECT *, array_to_string(regexp_extract_all(query_text, '{_THREE}'), ' ') AS tt FROM pats) GROUP BY 1)
"""


@query("domain_heat_map", f"WITH {_PATTERNS}, {_HEAT} SELECT * FROM heat", ("query_log",))
def _(t):
    return X.domain_heat_map(_patterns(t))


@query(
    "coverage_gaps",
    f"""
    WITH {_PATTERNS}, {_HEAT},
    vol AS (SELECT {_DOMAIN_CASE} AS business_domain, count(*) AS query_count
            FROM (SELECT lower(database_name) AS tt FROM query_log) GROUP BY 1)
    SELECT coalesce(v.business_domain, h.business_domain) AS business_domain, coalesce(query_count, 0) AS query_count,
      coalesce(pattern_count, 0) AS pattern_count, coalesce(max_users, 0) AS max_users,
      CASE WHEN coalesce(pattern_count, 0) = 0 THEN 'NO_PATTERNS'
           WHEN coalesce(query_count, 0) >= 1000 AND coalesce(pattern_count, 0) <= 5 THEN 'HIGH_VOLUME_LOW_COVERAGE'
           WHEN coalesce(pattern_count, 0) <= 5 AND coalesce(max_users, 0) >= 10 THEN 'FEW_PATTERNS_MANY_USERS'
           ELSE 'COVERED' END AS gap
    FROM vol v FULL JOIN heat h ON v.business_domain = h.business_domain
    """,
    ("query_log",),
)
def _(t):
    volume = t.query_log.groupBy(
        F.coalesce(X.pattern_domain(F.col("database_name")), F.lit("OTHER")).alias("business_domain")
    ).agg(F.count(F.lit(1)).alias("query_count"))
    return X.coverage_gaps(X.domain_heat_map(_patterns(t)), volume)


@query(
    "cross_db_chains",
    f"""
    WITH {_PATTERNS},
    r AS (SELECT pattern_hash, distinct_users, unnest(n) AS nm, unnest(range(len(n))) AS pos
          FROM (SELECT *, regexp_extract_all(query_text, '{_THREE}') AS n FROM pats)),
    f AS (SELECT pattern_hash, any_value(distinct_users) AS distinct_users, upper(split_part(nm, '.', 1)) AS db, min(pos) AS pos
          FROM r GROUP BY pattern_hash, upper(split_part(nm, '.', 1))),
    ch AS (SELECT pattern_hash, any_value(distinct_users) AS distinct_users, string_agg(db, ' -> ' ORDER BY pos) AS chain,
             count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= 2)
    SELECT chain, count(*) AS pattern_count, max(distinct_users) AS max_users,
           CASE WHEN n = 2 THEN 'direct' ELSE 'transitive' END AS kind FROM ch GROUP BY chain, n
    """,
    ("query_log",),
)
def _(t):
    return X.cross_db_chains(_patterns(t))


@query(
    "semi_structured_usage",
    f"""
    WITH {_PATTERNS}, k AS (
      SELECT 'json_parse' AS kind, * FROM pats WHERE regexp_matches(query_text, '(?i)(TRY_)?PARSE_JSON\\s*\\(')
      UNION ALL SELECT 'path_access', * FROM pats WHERE regexp_matches(query_text, '(?i)\\w+:\\w+')
      UNION ALL SELECT 'flatten', * FROM pats WHERE regexp_matches(query_text, '(?i)LATERAL\\s+FLATTEN\\s*\\(')
      UNION ALL SELECT 'construct', * FROM pats WHERE regexp_matches(query_text, '(?i)(OBJECT_CONSTRUCT|ARRAY_AGG)\\s*\\('))
    SELECT kind, count(*) AS pattern_count, CAST(sum(execution_count) AS BIGINT) AS execution_count,
           max(distinct_users) AS max_users FROM k GROUP BY 1
    """,
    ("query_log",),
)
def _(t):
    return X.semi_structured_usage(_patterns(t))


@query(
    "operational_signals",
    f"""
    WITH {_PATTERNS}
    SELECT pattern_hash, regexp_matches(upper(query_text), '>=\\s*CURRENT_DATE|DATEADD\\(\\s*MIN') AS real_time,
      regexp_matches(upper(query_text), '\\b(E?911|PII|AUDIT|COMPLIANCE|REGULATORY)\\b') AS compliance,
      regexp_matches(upper(query_text), '\\bJOIN\\b')
        AND regexp_matches(upper(query_text), '(SUBSCRIBER|CUSTOMER|ACCT|ACCOUNT)_ID') AS cross_product_identity,
      execution_count >= 10 AS high_frequency
    FROM pats
    """,
    ("query_log",),
)
def _(t):
    return X.operational_signals(_patterns(t), frequent=10)


@query(
    "keyword_usage",
    f"""
    SELECT query_text, query_type, database_name, regexp_extract(query_text, '\\w+\\.(\\w+)\\.\\w+', 1) AS schema_name, user_name, count(*) AS execution_count FROM query_log
    WHERE {since("start_time")} AND (lower(query_text) LIKE '%flatten%' OR lower(query_text) LIKE '%search\\_preview%' ESCAPE '\\')
    GROUP BY 1, 2, 3, 4, 5 ORDER BY 6 DESC, 1, 2, 3, 4, 5 LIMIT 50
    """,
    ("query_log",),
)
def _(t):
    log = t.query_log.withColumn("schema_name", F.regexp_extract("query_text", r"\w+\.(\w+)\.\w+", 1))
    return X.keyword_usage(log, ["FLATTEN", "SEARCH_PREVIEW"], AS_OF, ALL_DAYS)


@query(
    "normalized_texts",
    f"SELECT {_NORMAL} AS pattern, count(*) AS query_count FROM query_log GROUP BY 1",
    ("query_log",),
)
def _(t):
    return t.query_log.groupBy(normalized_text("query_text").alias("pattern")).agg(F.count(F.lit(1)).alias("query_count"))


@query(
    "normalize_table",
    """
    WITH n AS (SELECT lower(regexp_extract(query_text, '(?i)FROM\\s+([\\w.]+)', 1)) AS raw_name FROM query_log), u AS (SELECT raw_name, upper(trim(raw_name)) AS u FROM n WHERE raw_name <> '')
    SELECT raw_name, CASE WHEN len(string_split(u, '..')) = 2 THEN split_part(u, '..', 1) || '.PUBLIC.' || split_part(u, '..', 2) ELSE u END AS table_name, count(*) AS query_count FROM u GROUP BY 1, 2
    """,
    ("query_log",),
)
def _(t):
    raw = F.lower(F.regexp_extract("query_text", r"(?i)FROM\s+([\w.]+)", 1))
    counted = t.query_log.groupBy(raw.alias("raw_name")).agg(F.count(F.lit(1)).alias("query_count")).filter("raw_name <> ''")
    return counted.select("raw_name", normalize_table(F.col("raw_name")).alias("table_name"), "query_count")
