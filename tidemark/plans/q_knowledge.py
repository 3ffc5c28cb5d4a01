"""Relations, watching, retrieval and question-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exact import as_large
from tidemark.operators import catalog as K
from tidemark.operators import questions as Q
from tidemark.operators import relations as R
from tidemark.operators import retrieval as S
from tidemark.operators import sqlmining as X
from tidemark.operators import watch as V
from tidemark.operators.usage import domain_of, flatten_access
from tidemark.plans.inputs import AS_OF, EVENTS_AS_OF
from tidemark.plans.oracle_inputs import pick as sql_pick
from tidemark.plans.q_catalog import CLASSES_SQL, DESCRIBE_SQL, _parts_case, classes_of, hash_sql
from tidemark.plans.q_usage import ALL_DAYS, since
from tidemark.plans.registry import query
from tidemark.functions import naming as N

_AS_OF = f"TIMESTAMP '{AS_OF}'"
_EV_AS_OF = f"TIMESTAMP '{EVENTS_AS_OF}'"
_FQN = "database_name || '.' || schema_name || '.' || table_name"


# ---- relations ----

DECLARED_SQL = f"""declared AS (
  SELECT c.database_name || '.' || c.schema_name || '.' || c.table_name AS source_table, c.column_name AS source_column,
    t.database_name || '.' || t.schema_name || '.' || t.table_name AS target_table, c.ref_column AS target_column,
    'FK' AS relationship_type, 1.0::DOUBLE AS confidence, 'CONSTRAINT' AS detection_method
  FROM constraints c JOIN catalog_tables t ON t.database_name = c.database_name AND t.table_name = c.ref_table)"""

INFERRED_SQL = f"""tabs AS (SELECT database_name, schema_name, table_name, {_FQN} AS f, bool_or(column_name = 'ID') AS h
      FROM catalog_columns GROUP BY 1, 2, 3),
  refs AS (SELECT *, {_FQN} AS src, left(column_name, length(column_name) - 3) AS base FROM catalog_columns WHERE column_name LIKE '%\\_ID' ESCAPE '\\'),
  opts AS (SELECT *, base AS o, 0 AS p FROM refs UNION ALL SELECT *, base || 'S', 1 FROM refs
           UNION ALL SELECT *, left(base, length(base) - 1), 2 FROM refs WHERE ends_with(base, 'S')),
  hits AS (SELECT o.src, o.column_name, o.p, t.f, t.h, (t.database_name = o.database_name AND t.schema_name = o.schema_name) AS near
           FROM opts o JOIN tabs t ON t.table_name = o.o),
  inferred_all AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY src, column_name ORDER BY p, near DESC, f) = 1),
  inferred AS (SELECT src AS source_table, column_name AS source_column, f AS target_table, 'ID' AS target_column,
    'INFERRED_FK' AS relationship_type, 0.85::DOUBLE AS confidence, 'NAME_MATCH' AS detection_method, h AS target_has_column
    FROM inferred_all WHERE src <> f)"""


@query("relations_declared", f"WITH {DECLARED_SQL} SELECT * FROM declared", ("catalog_tables", "constraints"))
def _(t):
    return R.relations_declared(t.constraints, t.catalog_tables)


@query("relations_inferred", f"WITH {INFERRED_SQL} SELECT * FROM inferred", ("catalog_columns",))
def _(t):
    return R.relations_inferred(t.catalog_columns)


@query(
    "relations_first_column",
    f"""
    WITH keys AS (SELECT database_name, table_name AS t, column_name AS k, {_FQN} AS tgt FROM catalog_columns WHERE ordinal = 1),
    a AS (SELECT database_name, t || '_ID' AS nm, min(tgt) AS tgt, arg_min(k, tgt) AS k FROM keys GROUP BY 1, 2),
    b AS (SELECT database_name, k AS nm, min(tgt) AS tgt, arg_min(k, tgt) AS k FROM keys GROUP BY 1, 2),
    u AS (SELECT database_name, {_FQN} AS src, column_name AS c FROM catalog_columns WHERE data_type IN ('NUMBER', 'VARCHAR', 'TEXT'))
    SELECT DISTINCT src AS source_table, c AS source_column, tgt AS target_table, k AS target_column,
      'INFERRED_FK' AS relationship_type, 0.80::DOUBLE AS confidence, 'FIRST_COLUMN' AS detection_method
    FROM (SELECT u.src, u.c, a.tgt, a.k FROM u JOIN a ON a.database_name = u.database_name AND a.nm = u.c
          UNION ALL SELECT u.src, u.c, b.tgt, b.k FROM u JOIN b ON b.database_name = u.database_name AND b.nm = u.c)
    WHERE src <> tgt
    """,
    ("catalog_columns",),
)
def _(t):
    return R.relations_first_column(t.catalog_columns)


@query(
    "relations_shared",
    f"""
    WITH m AS (SELECT database_name, column_name AS source_column, string_split(data_type, '(')[1] AS base, schema_name AS s, {_FQN} AS source_table
               FROM catalog_columns WHERE NOT regexp_matches(column_name, '_ID$|^ID$')),
    g AS (SELECT database_name, source_column, base, count(DISTINCT source_table) AS group_size, min(source_table) AS target_table
          FROM m GROUP BY 1, 2, 3 HAVING count(DISTINCT source_table) >= 2 AND count(DISTINCT s) <= 3)
    SELECT source_table, source_column, target_table, source_column AS target_column, 'SHARED_KEY' AS relationship_type,
      0.70::DOUBLE AS confidence, 'NAME_MATCH' AS detection_method, group_size,
      CAST(group_size * (group_size - 1) // 2 AS BIGINT) AS group_pairs
    FROM m JOIN g USING (database_name, source_column, base) WHERE source_table <> target_table
    """,
    ("catalog_columns",),
)
def _(t):
    return R.relations_shared(t.catalog_columns, max_schemas=3)


@query(
    "relations_ontology",
    f"""
    WITH d AS (SELECT table_name AS a, column_name AS c, ref_table AS b FROM constraints)
    SELECT s.f AS source_table, d.c AS source_column, x.f AS target_table, 'ID' AS target_column,
      'ONTOLOGY' AS relationship_type, 1.0::DOUBLE AS confidence, 'ONT_REL_DEF' AS detection_method
    FROM d JOIN (SELECT table_name, {_FQN} AS f FROM catalog_tables) s ON s.table_name = d.a
    JOIN (SELECT table_name, {_FQN} AS f FROM catalog_tables) x ON x.table_name = d.b
    """,
    ("catalog_tables", "constraints"),
)
def _(t):
    definitions = t.constraints.select(
        F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"),
        F.col("ref_table").alias("range_table"), F.col("ref_column").alias("target_column"),
    )
    return R.relations_ontology(t.catalog_tables, definitions)


MERGED_SQL = f"""{DECLARED_SQL}, {INFERRED_SQL},
  merged AS (SELECT source_table, source_column, target_table, target_column, relationship_type, confidence, detection_method
    FROM (SELECT * FROM declared UNION ALL SELECT * EXCLUDE (target_has_column) FROM inferred)
    QUALIFY row_number() OVER (PARTITION BY source_table, target_table, relationship_type ORDER BY confidence DESC, source_column) = 1)"""


def merged_relations(t):
    found = R.relations_declared(t.constraints, t.catalog_tables).unionByName(
        R.relations_inferred(t.catalog_columns).drop("target_has_column")
    )
    return R.merge_relations(found)


@query("merge_relations", f"WITH {MERGED_SQL} SELECT * FROM merged", ("catalog_tables", "catalog_columns", "constraints"))
def _(t):
    return merged_relations(t)


_FACT_DIM = """fd AS (SELECT f.database_name, lower(f.table_name) || '_to_' || lower(d.table_name) AS name,
    lower(f.table_name) AS left_table, lower(d.table_name) AS right_table,
    array_to_string(list_slice(list_sort(list_distinct(list(f.column_name))), 1, 3), ',') AS relationship_columns
  FROM catalog_columns f JOIN catalog_columns d ON f.database_name = d.database_name AND f.column_name = d.column_name
  WHERE regexp_matches(f.column_name, '(_ID|_KEY)$') AND contains(f.table_name, 'FCT_') AND contains(d.table_name, 'DIM_')
  GROUP BY f.database_name, f.table_name, d.table_name)"""


@query("fact_dim_relations", f"WITH {_FACT_DIM} SELECT * FROM fd", ("catalog_columns",))
def _(t):
    return R.fact_dim_relations(t.catalog_columns)


# ---- watching ----

_STATES = f"""states AS (
  WITH u AS (SELECT object_name, count(*) AS n FROM access WHERE {since("ts", ALL_DAYS)} AND object_domain = 'Table' GROUP BY 1),
  k AS (SELECT * FROM concepts WHERE is_active), l AS (SELECT *, {_FQN} AS f FROM current_tables)
  SELECT coalesce(k.full_name, l.f) AS object_fqn,
    CASE WHEN k.full_name IS NULL AND coalesce(u.n, 0) > 0 THEN 'SHADOW_ACTIVE' WHEN k.full_name IS NULL THEN 'SHADOW_INACTIVE'
         WHEN l.f IS NULL THEN 'KNOWN_DELETED' WHEN k.quality_score < 0.3 THEN 'ONBOARDED_INCORRECTLY'
         WHEN l.last_altered > k.enriched_at THEN 'KNOWN_DRIFTED' ELSE 'KNOWN_CURRENT' END AS object_state,
    coalesce(u.n, 0) AS access_count
  FROM k FULL JOIN l ON k.full_name = l.f LEFT JOIN u ON u.object_name = coalesce(k.full_name, l.f))"""


def _states(t):
    return V.watch_states(t.concepts, t.current_tables, t.access_log, AS_OF, ALL_DAYS)


@query(
    "watch_states",
    f"""
    WITH {_STATES}
    SELECT *, CASE WHEN object_state IN ('KNOWN_DRIFTED', 'ONBOARDED_INCORRECTLY') THEN 're-enrich' WHEN object_state = 'SHADOW_ACTIVE'
      THEN 'onboard' WHEN object_state = 'SHADOW_INACTIVE' THEN 'defer' ELSE 'ignore' END AS triage_action FROM states
    """,
    ("catalog_tables", "current_tables", "concepts", "access"),
)
def _(t):
    return _states(t)


@query(
    "match_class",
    f"""
    WITH {CLASSES_SQL},
    cc AS (SELECT c.class_name, k.column_name AS col FROM classes c JOIN catalog_columns k ON k.table_name = c.source_table),
    tc AS (SELECT {_FQN} AS table_name, column_name AS col FROM catalog_columns_new WHERE column_name <> 'ID'),
    n1 AS (SELECT table_name, count(*) AS n FROM tc GROUP BY 1), n2 AS (SELECT class_name, count(*) AS n FROM cc GROUP BY 1),
    o AS (SELECT tc.table_name, cc.class_name, count(*) AS common FROM tc JOIN cc USING (col) GROUP BY 1, 2),
    j AS (SELECT table_name, class_name, common / (n1.n + n2.n - common) AS j FROM o JOIN n1 USING (table_name) JOIN n2 USING (class_name))
    SELECT table_name, class_name, round(j, 4) AS similarity, 'ontology_review' AS triage_action FROM j WHERE j >= 0.7
    QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY j DESC, class_name) = 1
    """,
    ("catalog_tables", "catalog_columns", "catalog_columns_new"),
)
def _(t):
    tables = t.catalog_columns_new.filter("column_name <> 'ID'").select(K.full_name().alias("name"), "column_name")
    classes = classes_of(t).select("class_name", "source_table").join(
        as_large(t.catalog_columns), F.col("source_table") == F.col("table_name")
    ).select(F.col("class_name").alias("name"), "column_name")
    return V.match_class(tables, classes)


@query(
    "ontology_drift",
    f"""
    WITH {CLASSES_SQL}, {hash_sql("o", "catalog_columns")}, {hash_sql("n", "catalog_columns_new")}
    SELECT source_name AS object_fqn, class_name, o.schema_hash AS old_hash, n.schema_hash AS new_hash, 'ONTOLOGY_DRIFT' AS object_state
    FROM classes c JOIN o ON o.database_name || '.' || o.schema_name || '.' || o.table_name = c.source_name
    JOIN n USING (database_name, schema_name, table_name) WHERE o.schema_hash <> n.schema_hash
    """,
    ("catalog_tables", "catalog_columns", "catalog_columns_new"),
)
def _(t):
    classes = classes_of(t).select("class_name", F.col("source_name").alias("source_table"))
    return V.ontology_drift(K.hashed(t.catalog_columns), K.hashed(t.catalog_columns_new), classes)


@query(
    "new_namespaces",
    f"""
    WITH k AS (SELECT * FROM catalog_tables WHERE size_code > 20 AND database_name <> 'PEOPLE' AND NOT (database_name = 'OPS_DB' AND schema_name = 'RAW'))
    SELECT 'database' AS level, database_name AS name FROM (SELECT DISTINCT database_name FROM catalog_tables
      WHERE database_name NOT IN (SELECT database_name FROM k))
    UNION ALL SELECT 'schema', database_name || '.' || schema_name FROM (SELECT DISTINCT database_name, schema_name FROM catalog_tables
      WHERE (database_name, schema_name) NOT IN (SELECT (database_name, schema_name) FROM k))
    UNION ALL SELECT 'table', {_FQN} FROM catalog_tables WHERE {_FQN} NOT IN (SELECT {_FQN} FROM k)
    """,
    ("catalog_tables",),
)
def _(t):
    known = t.catalog_tables.filter(
        "size_code > 20 AND database_name <> 'PEOPLE' AND NOT (database_name = 'OPS_DB' AND schema_name = 'RAW')"
    )
    return V.new_namespaces(t.catalog_tables, known)


_DATA_HASH = f"md5({_FQN} || CAST({{rows}} AS VARCHAR) || strftime(last_altered, '%Y-%m-%d %H:%M:%S'))"


@query(
    "data_hash_drift",
    f"""
    SELECT {_FQN} AS object_fqn, {_DATA_HASH.format(rows="(row_count + CASE WHEN size_code > 40 THEN 1 ELSE 0 END)")} AS new_hash,
           {_DATA_HASH.format(rows="row_count")} AS old_hash
    FROM catalog_tables WHERE size_code > 40
    """,
    ("catalog_tables",),
)
def _(t):
    c = t.catalog_tables
    stored = c.select(K.full_name().alias("object_fqn"), V.data_hash().alias("data_hash"))
    grown = c.withColumn("row_count", F.col("row_count") + F.when(F.col("size_code") > 40, 1).otherwise(0))
    return V.data_hash_drift(stored, grown)


@query(
    "triage",
    f"""
    WITH u AS (SELECT object_name, count(DISTINCT query_id) AS q, count(DISTINCT user_name) AS us FROM access WHERE {since("ts")} GROUP BY 1),
    c1 AS (SELECT {_FQN} AS f, count(*) AS n FROM catalog_columns GROUP BY 1),
    c2 AS (SELECT {_FQN} AS f, count(*) AS n FROM catalog_columns_new GROUP BY 1),
    o AS (SELECT {_FQN} AS f, t.*, c.concept_id IS NOT NULL AS is_known, c.quality_score,
            (t.size_code % 7 = 0) AS is_transient, t.row_count * (1 + t.size_code % 3) // 2 AS previous_rows
          FROM catalog_tables t LEFT JOIN (SELECT concept_id, part_key, quality_score FROM concepts) c USING (part_key))
    SELECT o.f AS full_name, CASE
      WHEN regexp_matches(schema_name, 'SCRATCH|TEMP') OR regexp_matches(table_name, '_TEMP_|_TMP_|_STAGING_')
        OR (is_transient AND coalesce(q, 0) = 0) OR row_count < 10 THEN 'AUTO_IGNORE'
      WHEN NOT is_known AND (coalesce(q, 0) > 100 OR coalesce(us, 0) > 5) THEN 'AUTO_ALERT'
      WHEN is_known AND (c2.n IS NOT NULL AND c2.n <> c1.n OR abs(row_count - previous_rows) > previous_rows * 0.5 OR quality_score < 0.3) THEN 'AUTO_FLAG'
      WHEN NOT is_known AND schema_name = 'CORE' THEN 'AUTO_ONBOARD' ELSE 'NONE' END AS triage
    FROM o LEFT JOIN u ON u.object_name = o.f LEFT JOIN c1 ON c1.f = o.f LEFT JOIN c2 ON c2.f = o.f
    """,
    ("catalog_tables", "concepts", "catalog_columns", "catalog_columns_new", "access"),
)
def _(t):
    return V.triage(triage_objects(t), ["core"])


def triage_objects(t):
    """Catalog objects with their use, size and column counts before and now."""
    used = (
        flatten_access(t.access_log)
        .groupBy("object_name")
        .agg(F.count_distinct("query_id").alias("queries"), F.count_distinct("user_name").alias("users"))
    )
    key = K.TABLE_KEY
    before = t.catalog_columns.groupBy(*key).agg(F.count(F.lit(1)).alias("previous_columns"))
    now = t.catalog_columns_new.groupBy(*key).agg(F.count(F.lit(1)).alias("column_count"))
    known = t.concepts.select("part_key", "quality_score", F.lit(True).alias("is_known"))
    return (
        t.catalog_tables.withColumn("full_name", K.full_name())
        .join(known, "part_key", "left")
        .join(used, F.col("full_name") == F.col("object_name"), "left")
        .join(before, key, "left")
        .join(now, key, "left")
        .fillna(0, ["queries", "users"])
        .fillna(False, ["is_known"])
        .withColumn("is_transient", F.col("size_code") % 7 == 0)
        .withColumn("previous_rows", F.floor(F.col("row_count") * (1 + F.col("size_code") % 3) / 2))
    )


# ---- retrieval ----

_WORDS = ["and", "the", "error", "license", "data"]


def _bm25_sql(where: str) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(sorted(_WORDS)))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(_WORDS)))
    score = " + ".join(
        f"ln(1.0 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / al))"
        for i in range(len(_WORDS))
    )
    return f"""
    WITH tk AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents {where}),
    c AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS len, {tf} FROM tk),
    f AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS al, {df} FROM c)
    SELECT doc_id, round({score}, 6) AS score FROM c, f WHERE round({score}, 6) > 0 ORDER BY score DESC, doc_id LIMIT 10
    """


@query("search", _bm25_sql(""))
def _(t):
    return S.search(t.table("documents"), "doc_id", "text", "the and ERROR license, data?", 10)


@query("search_filtered", _bm25_sql("WHERE lang = 'en'"))
def _(t):
    return S.search(t.table("documents"), "doc_id", "text", "the and ERROR license, data?", 10, {"lang": "en"})


_SPLIT = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"


@query(
    "search_many",
    f"""WITH tk AS (SELECT doc_id, {_SPLIT} AS t FROM documents), f AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS al FROM tk),
    p AS (SELECT doc_id, word, any_value(l) AS l, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS word FROM tk) GROUP BY ALL),
    w AS (SELECT word, ln(1.0 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, f GROUP BY word),
    q AS (SELECT DISTINCT item_id, unnest({_SPLIT}) AS word FROM benchmark),
    s AS (SELECT item_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))), 6) AS score FROM q JOIN w USING (word) JOIN p USING (word), f GROUP BY item_id, doc_id)
    SELECT item_id, doc_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
)
def _(t):
    return S.search_many(S.build_index(t.table("documents"), "doc_id", "text"), t.table("benchmark"), "item_id", "text")


_TARGET = [((i * 37) % 19 - 9) / 10 for i in range(64)]


@query(
    "nearest_vectors",
    f"""
    WITH q AS (SELECT [{", ".join(str(x) for x in _TARGET)}]::DOUBLE[] AS v),
    s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], v) AS d, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS a,
            sqrt(list_dot_product(v, v)) AS b FROM embeddings, q)
    SELECT vec_id, round(d / (a * b), 6) AS similarity FROM s ORDER BY similarity DESC, vec_id LIMIT 10
    """,
)
def _(t):
    return S.nearest_vectors(t.table("embeddings"), "vec_id", "embedding", _TARGET)


HITS_SQL = """asked AS (SELECT DISTINCT q.question_id, q.asked_at, c.full_name
  FROM (SELECT question_id, asked_at, unnest(concepts_used) AS concept_id FROM question_log) q JOIN concepts c USING (concept_id))"""


def _hits(t):
    used = t.question_log.select("question_id", "asked_at", F.explode("concepts_used").alias("concept_id"))
    return used.join(t.concepts.select("concept_id", "full_name"), "concept_id")


_ASSEMBLED = f"""assembled AS (
  WITH j AS (SELECT DISTINCT source_table AS full_name, source_column AS column_name, 1 AS j FROM merged),
  d AS (SELECT c.*, {_FQN} AS full_name, {_parts_case("column_name", N.ROLE_PARTS, "attribute")} AS role FROM catalog_columns c),
  r AS (SELECT d.*, row_number() OVER (PARTITION BY d.full_name ORDER BY CASE role WHEN 'key' THEN 1 WHEN 'metric' THEN 2
          WHEN 'timestamp' THEN 3 ELSE CASE WHEN j.j = 1 THEN 4 ELSE 5 END END, ordinal, d.column_name) AS position
        FROM d LEFT JOIN j ON j.full_name = d.full_name AND j.column_name = d.column_name)
  SELECT h.question_id, h.full_name, column_name, data_type, role, position
  FROM asked h JOIN r ON r.full_name = h.full_name WHERE position <= 20)"""
_ASSEMBLY_USES = ("catalog_tables", "catalog_columns", "constraints", "concepts", "question_log")


@query("assemble_schema", f"WITH {MERGED_SQL}, {HITS_SQL}, {_ASSEMBLED} SELECT * FROM assembled", _ASSEMBLY_USES)
def _(t):
    return S.assemble_schema(_hits(t), t.catalog_columns, merged_relations(t))


@query(
    "internal_relations",
    f"""
    WITH {MERGED_SQL}, {HITS_SQL}, h AS (SELECT DISTINCT year(asked_at) * 12 + month(asked_at) AS question_id, full_name FROM asked)
    SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, source_table, target_table, source_column, target_column, relationship_type) AS position,
      source_table, source_column, target_table, target_column, relationship_type, confidence
    FROM h JOIN merged ON source_table = full_name WHERE (question_id, target_table) IN (SELECT (question_id, full_name) FROM h)
    """,
    _ASSEMBLY_USES,
)
def _(t):
    monthly = _hits(t).withColumn("question_id", (F.year("asked_at") * 12 + F.month("asked_at")).cast("bigint"))  # what a month asks about
    return S.internal_relations(monthly, merged_relations(t))


@query(
    "assembly_checks",
    f"""
    WITH {MERGED_SQL}, {HITS_SQL}, {_ASSEMBLED},
    a AS (SELECT question_id, count(DISTINCT full_name) AS t, count(*) AS c, count(*) FILTER (role = 'metric') AS m FROM assembled GROUP BY 1),
    i AS (SELECT DISTINCT x.question_id, m.source_table, m.target_table FROM (SELECT DISTINCT question_id, full_name FROM assembled) x
          JOIN merged m ON m.source_table = x.full_name
          JOIN (SELECT DISTINCT question_id, full_name FROM assembled) y ON y.question_id = x.question_id AND y.full_name = m.target_table),
    w AS (SELECT question_id, count(DISTINCT full_name) AS n FROM asked GROUP BY 1)
    SELECT w.question_id, coalesce(t, 0) >= 1 AS has_table,
      coalesce(t, 0) <= 1 OR w.question_id IN (SELECT question_id FROM i) AS has_joins, coalesce(m, 0) > 0 AS has_metric,
      coalesce(c, 0) <= 50 AS within_size, coalesce(t, 0) = n AS names_exist
    FROM w LEFT JOIN a USING (question_id)
    """,
    _ASSEMBLY_USES,
)
def _(t):
    hits, links = _hits(t), merged_relations(t)
    return S.assembly_checks(hits, S.assemble_schema(hits, t.catalog_columns, links), links)


@query(
    "assembly_cache",
    f"""
    WITH {HITS_SQL},
    s AS (SELECT question_id, string_agg(full_name, ',' ORDER BY full_name) AS tables, max(asked_at) AS last_at FROM asked GROUP BY 1)
    SELECT sha256(tables) AS cache_key, tables, count(*) AS hit_count, max(last_at) AS last_hit_at,
           max(last_at) >= TIMESTAMP '2024-01-01 00:00:00' AS is_valid FROM s GROUP BY 1, 2
    """,
    ("catalog_tables", "concepts", "question_log"),
)
def _(t):
    return S.assembly_cache(_hits(t), "2024-01-01 00:00:00")


_NORM_Q = "regexp_replace(trim(lower(question)), '\\s+', ' ', 'g')"
_INTENT = """CASE WHEN regexp_matches(nq, 'compare|versus|vs|difference') THEN 'compare'
  WHEN regexp_matches(nq, 'sum|total|count|average|avg|how many') THEN 'aggregation' ELSE 'lookup' END"""
_TIME = "regexp_matches(nq, 'today|yesterday|last week|last month|last quarter|last year')"


def _phrased(t):
    """Questions in words: user turns wrapped into one of six phrases."""
    phrases = ["compare {} with last year", "How  many {} today", "list {}", "Total of {}", "show {}", "What was {} last month"]
    k = F.col("conv_id") * 3 + F.col("turn")
    from tidemark.plans.inputs import pick

    return t.table("conversations").filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"),
        F.replace(pick(phrases, k), F.lit("{}"), F.col("text")).alias("question"),
        F.when(F.col("turn") > 3, pick(["SALES", "finance", "NOWHERE"], F.col("conv_id"))).alias("domain_hint"),
    )


_PHRASED = f"""phrased AS (SELECT conv_id * 1000 + turn AS question_id,
  replace({sql_pick(["compare {} with last year", "How  many {} today", "list {}", "Total of {}", "show {}", "What was {} last month"], "conv_id * 3 + turn")}, '{{}}', text) AS question,
  CASE WHEN turn > 3 THEN {sql_pick(["SALES", "finance", "NOWHERE"], "conv_id")} END AS domain_hint
  FROM conversations WHERE role = 'user')"""


@query(
    "question_intent",
    f"""
    WITH {_PHRASED}
    SELECT question_id, md5(nq) AS text_hash, {_INTENT} AS detected_intent, {_TIME} AS has_time_scope
    FROM (SELECT *, {_NORM_Q} AS nq FROM phrased)
    """,
)
def _(t):
    return S.question_intent(_phrased(t)).select(
        "question_id", F.md5("normalized_question").alias("text_hash"), "detected_intent", "has_time_scope"
    )


_REGISTRY = """registry AS (SELECT domain, CASE WHEN count(*) % 4 = 0 THEN 'GRADUATED' WHEN count(*) % 4 = 1 THEN 'ACTIVE'
    WHEN count(*) % 4 = 2 THEN 'ENRICHED' ELSE 'NEW' END AS status, domain <> 'SALES' AS has_agent, true AS has_index,
    max(enriched_at) AS updated_at, count(*) FILTER (quality_score < 0.1) AS open_conflicts FROM concepts GROUP BY 1)"""


def _registry(t):
    n = F.count(F.lit(1))
    return t.concepts.groupBy("domain").agg(
        F.when(n % 4 == 0, "GRADUATED").when(n % 4 == 1, "ACTIVE").when(n % 4 == 2, "ENRICHED").otherwise("NEW").alias("status"),
        F.max("enriched_at").alias("updated_at"),
        F.count_if(F.col("quality_score") < 0.1).alias("open_conflicts"),
    ).withColumns({"has_agent": F.col("domain") != "SALES", "has_index": F.lit(True)})


@query(
    "route_question",
    f"""
    WITH {_PHRASED}, {_REGISTRY},
    best AS (SELECT domain FROM registry WHERE status <> 'NEW' ORDER BY CASE status WHEN 'GRADUATED' THEN 1 WHEN 'ACTIVE' THEN 2 ELSE 3 END,
             updated_at DESC, domain LIMIT 1),
    q AS (SELECT *, {_INTENT} AS intent, {_TIME} AS ts FROM (
            SELECT *, {_NORM_Q} AS nq, coalesce(upper(domain_hint), (SELECT domain FROM best)) AS d FROM phrased)),
    r AS (SELECT q.*, status, has_agent, has_index, open_conflicts,
            (CASE WHEN intent = 'aggregation' THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN ts THEN 0.05::DOUBLE ELSE 0 END) AS extra
          FROM q LEFT JOIN registry ON registry.domain = q.d)
    SELECT question_id, d AS domain, intent AS detected_intent, ts AS has_time_scope,
      CASE WHEN status = 'GRADUATED' AND has_agent THEN 'ONTOLOGY_AGENT' WHEN status IN ('ACTIVE', 'ENRICHED') THEN 'TRANSIENT_CONTRACT'
           ELSE 'AMBIGUOUS' END AS route,
      round(CASE WHEN status = 'GRADUATED' AND has_agent THEN 0.95::DOUBLE WHEN status = 'ACTIVE' THEN least(0.75 + extra, 0.95)
           WHEN status = 'ENRICHED' THEN least(0.65 + extra, 0.95) - 0.05 ELSE 0.20 END, 2) AS confidence,
      CASE WHEN (status = 'GRADUATED' AND has_agent) OR status = 'ACTIVE' THEN ''
           WHEN status = 'ENRICHED' THEN 'answered without the search index, which is not in use yet'
           ELSE 'nothing is prepared to answer from ' || d END AS warning,
      coalesce(open_conflicts, 0) AS blocking_conflicts, sha256(nq) AS plan_id
    FROM r
    """,
    ("catalog_tables", "concepts"),
)
def _(t):
    return S.route_question(_phrased(t), _registry(t))


@query(
    "build_contract",
    f"""
    WITH {MERGED_SQL},
    c AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY usage_count DESC, quality_score DESC, full_name) AS rn FROM concepts WHERE is_active),
    ct AS (SELECT domain, string_agg(full_name, ',' ORDER BY rn) AS tables FROM c WHERE rn <= 5 GROUP BY 1),
    r AS (SELECT c.domain, m.*, row_number() OVER (PARTITION BY c.domain ORDER BY m.confidence DESC, source_table, target_table, source_column) AS rn
          FROM merged m JOIN c ON c.full_name = m.source_table),
    j AS (SELECT domain, string_agg(CAST(rn AS VARCHAR) || ':' || source_table || '->' || target_table, ',' ORDER BY rn) AS joins FROM r WHERE rn <= 10 GROUP BY 1)
    SELECT ct.domain, tables, coalesce(joins, '') AS joins, CASE WHEN ct.domain = 'SALES' THEN 'sum_total_amount' ELSE '' END AS metric
    FROM ct LEFT JOIN j USING (domain)
    """,
    ("catalog_tables", "catalog_columns", "constraints", "concepts"),
)
def _(t):
    metrics = X.mine_metrics(t.query_log).filter("metric_name like 'sum_total%'").select(F.lit("SALES").alias("domain"), "metric_name")
    return S.build_contract(t.concepts, merged_relations(t), metrics)


@query(
    "validate_contract",
    f"""
    WITH s AS (SELECT part_key AS spec_id, {_FQN} AS t, unnest(['ID', 'REGION', 'STATUS_CODE', NULL]) AS c FROM catalog_tables),
    k AS (SELECT DISTINCT {_FQN} AS t, column_name AS c FROM catalog_columns_new),
    m AS (SELECT spec_id, t AS missing FROM s WHERE t NOT IN (SELECT t FROM k)
          UNION SELECT spec_id, t || '.' || c FROM s WHERE c IS NOT NULL AND t IN (SELECT t FROM k) AND (t || '|' || c) NOT IN (SELECT t || '|' || c FROM k))
    SELECT spec_id, CASE WHEN min(missing) IS NULL THEN 'VALID' ELSE 'INVALID' END AS status, min(missing) AS error, count(DISTINCT missing) AS missing_names
    FROM (SELECT DISTINCT spec_id FROM s) LEFT JOIN m USING (spec_id) GROUP BY 1
    """,
    ("catalog_tables", "catalog_columns_new"),
)
def _(t):
    specs = t.catalog_tables.select(
        F.col("part_key").alias("spec_id"), K.full_name().alias("table_name"),
        F.explode(F.array(F.lit("ID"), F.lit("REGION"), F.lit("STATUS_CODE"), F.lit(None).cast("string"))).alias("column_name"),
    )
    return S.validate_contract(specs, t.catalog_columns_new)


# ---- question log ----

def _asked(days: int) -> str:
    return f"asked_at >= {_EV_AS_OF} - INTERVAL {days} DAY"


_RATE = "round(count(*) FILTER (status = 'OK') / CAST(count(*) AS DOUBLE), 4)"
_QUSES = ("catalog_tables", "concepts", "question_log")
_USED = f"used AS (SELECT question_id, status, helpful, unnest(list_distinct(concepts_used)) AS concept_id FROM question_log WHERE {_asked(90)})"


@query(
    "promotion_candidates",
    f"""
    WITH q AS (SELECT *, array_to_string(list_sort(concepts_used), ',') AS concepts FROM question_log WHERE {_asked(90)}),
    s AS (SELECT concepts, count(*) AS query_count, {_RATE} AS success_rate FROM q GROUP BY 1
          HAVING count(*) >= 2 AND {_RATE} >= 0.5),
    d AS (SELECT concepts, sha256(question) AS h FROM (SELECT DISTINCT concepts, question FROM q)
          QUALIFY row_number() OVER (PARTITION BY concepts ORDER BY question) <= 3)
    SELECT s.*, (SELECT string_agg(h, ',' ORDER BY h) FROM d WHERE d.concepts = s.concepts) AS sample_questions FROM s
    """,
    ("question_log",),
)
def _(t):
    return Q.promotion_candidates(t.question_log, EVENTS_AS_OF, 90, 2, 0.5)


_USAGE = f"""{_USED}, usage AS (SELECT concept_id, count(*) AS usage_count, {_RATE} AS success_rate,
  round(count(*) FILTER (helpful) / CAST(count(*) AS DOUBLE), 4) AS helpfulness_rate, any_value(full_name) AS full_name
  FROM used JOIN concepts USING (concept_id) GROUP BY 1)"""


@query("concept_usage", f"WITH {_USAGE} SELECT * FROM usage", _QUSES)
def _(t):
    return Q.concept_usage(t.concepts, t.question_log, EVENTS_AS_OF, 90)


@query(
    "low_performers", f"WITH {_USAGE} SELECT * FROM usage WHERE usage_count >= 3 AND success_rate < 0.9", _QUSES
)
def _(t):
    return Q.low_performers(Q.concept_usage(t.concepts, t.question_log, EVENTS_AS_OF, 90), 3, 0.9)


@query(
    "failing_questions",
    f"""
    SELECT question, status, error_message, count(*) AS occurrence_count FROM question_log
    WHERE {_asked(90)} AND status IN ('ERROR', 'EMPTY') GROUP BY 1, 2, 3
    ORDER BY 4 DESC, 1, 2, 3 NULLS FIRST LIMIT 20
    """,
    ("question_log",),
)
def _(t):
    return Q.failing_questions(t.question_log, EVENTS_AS_OF, 90)


@query(
    "quality_vs_success",
    f"""
    WITH {_USED}, d AS (SELECT DISTINCT quality_score, question_id, status FROM used JOIN concepts USING (concept_id))
    SELECT quality_score, count(*) AS queries, {_RATE} AS success_rate FROM d GROUP BY 1
    """,
    _QUSES,
)
def _(t):
    return Q.quality_vs_success(t.concepts, t.question_log, EVENTS_AS_OF, 90)


@query(
    "unused_concepts",
    f"WITH {_USED} SELECT concept_id, full_name, enriched_at FROM concepts WHERE is_active AND concept_id NOT IN (SELECT concept_id FROM used)",
    _QUSES,
)
def _(t):
    return Q.unused_concepts(t.concepts, t.question_log, EVENTS_AS_OF, 90)


@query(
    "health_summary",
    f"""
    WITH {_STATES}, c AS (SELECT * FROM concepts WHERE is_active), figures AS (
    SELECT 'total_concepts' AS metric, CAST(count(*) AS DOUBLE) AS value FROM c
    UNION ALL SELECT 'avg_quality_score', round(CAST(sum(CAST(quality_score AS DECIMAL(18,4))) AS DOUBLE) / count(*), 2) FROM c
    UNION ALL SELECT 'concepts_needing_re_enrich', CAST(count(*) AS DOUBLE) FROM c WHERE quality_score < 0.5
    UNION ALL SELECT 'shadow_objects', CAST(count(*) AS DOUBLE) FROM states WHERE object_state LIKE 'SHADOW%'
    UNION ALL SELECT 'drifted_objects', CAST(count(*) AS DOUBLE) FROM states WHERE object_state = 'KNOWN_DRIFTED')
    SELECT *, CAST(NULL AS VARCHAR) AS detail FROM figures
    UNION ALL SELECT 'last_refresh', NULL, strftime(max(enriched_at), '%Y-%m-%d %H:%M:%S') FROM concepts
    """,
    ("catalog_tables", "current_tables", "concepts", "access"),
)
def _(t):
    return Q.health_summary(t.concepts, _states(t))


@query(
    "scoped_concepts",
    """
    SELECT full_name, domain FROM concepts
    WHERE domain IN (SELECT c.domain FROM catalog_tables x JOIN concepts c USING (part_key) WHERE x.owner = 'ROLE_7')
    """,
    ("catalog_tables", "concepts"),
)
def _(t):
    role_map = t.catalog_tables.select(F.col("owner").alias("role_name"), "part_key").join(
        t.concepts.select("part_key", "domain"), "part_key"
    )
    return Q.scoped_concepts(t.concepts, role_map, "role_7").select("full_name", "domain")


_LINKED = """linked AS (SELECT c.domain, m.* FROM merged m JOIN (SELECT full_name, domain FROM concepts WHERE is_active) c ON c.full_name = m.source_table)"""
_KUSES = ("catalog_tables", "catalog_columns", "constraints", "concepts")


@query(
    "graduation_ready",
    f"""
    WITH {MERGED_SQL}, {_LINKED},
    a AS (SELECT domain, count(DISTINCT full_name) AS table_count, CAST(sum(usage_count) AS BIGINT) AS total_queries FROM concepts WHERE is_active GROUP BY 1),
    l AS (SELECT domain, count(DISTINCT source_table) AS relation_count FROM linked GROUP BY 1)
    SELECT domain, table_count, total_queries, relation_count FROM a JOIN l USING (domain) WHERE table_count >= 3 AND relation_count >= 2
    """,
    _KUSES,
)
def _(t):
    return Q.graduation_ready(t.concepts, merged_relations(t))


@query(
    "top_tables",
    """
    SELECT domain, full_name, usage_count, rn AS position FROM (
      SELECT *, row_number() OVER (PARTITION BY domain ORDER BY usage_count DESC, full_name) AS rn FROM concepts WHERE is_active) WHERE rn <= 20
    """,
    ("catalog_tables", "concepts"),
)
def _(t):
    return Q.top_tables(t.concepts)


@query(
    "top_keywords",
    """
    SELECT domain, keyword, freq FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY freq DESC, keyword) AS rn FROM (
      SELECT domain, keyword, count(*) AS freq FROM (SELECT domain, unnest(keywords) AS keyword FROM concepts) GROUP BY 1, 2)) WHERE rn <= 15
    """,
    ("catalog_tables", "concepts"),
)
def _(t):
    return Q.top_keywords(t.concepts)


@query(
    "conflict_summary",
    f"""
    WITH {MERGED_SQL}, {_LINKED},
    a AS (SELECT domain, count(*) AS active_concepts FROM concepts WHERE is_active GROUP BY 1),
    l AS (SELECT domain, count(*) AS n FROM linked GROUP BY 1),
    o AS (SELECT domain, count(*) AS n, count(*) FILTER (quality_score < 0.2) AS h FROM concepts WHERE quality_score < 0.4 AND has_joins GROUP BY 1)
    SELECT domain, active_concepts, coalesce(l.n, 0) AS active_relationships, coalesce(o.n, 0) AS open_conflicts, coalesce(o.h, 0) AS high_conflicts
    FROM a LEFT JOIN l USING (domain) LEFT JOIN o USING (domain)
    """,
    _KUSES,
)
def _(t):
    conflicts = t.concepts.filter("quality_score < 0.4").select(
        "domain", F.when(F.col("quality_score") < 0.2, "HIGH").otherwise("LOW").alias("severity"),
        F.when(F.col("has_joins"), "OPEN").otherwise("CLOSED").alias("resolution_status"),
    )
    return Q.conflict_summary(t.concepts, merged_relations(t), conflicts)


@query(
    "verify_metrics",
    """
    SELECT column_name AS metric_name, 'SUM(' || data_type || ')' AS expr,
      CASE WHEN n < 20 THEN 'UNDECIDED' WHEN data_type = 'NUMBER' THEN 'CONFIRMED' ELSE 'CONFLICT' END AS status
    FROM (SELECT column_name, data_type, count(*) AS n FROM catalog_columns GROUP BY 1, 2)
    """,
    ("catalog_columns",),
)
def _(t):
    counted = t.catalog_columns.groupBy("column_name", "data_type").agg(F.count(F.lit(1)).alias("n"))
    definitions = counted.select(F.col("column_name").alias("metric_name"), F.concat(F.lit("SUM("), "data_type", F.lit(")")).alias("expr"))
    decisions = counted.filter("n >= 20").select(F.col("column_name").alias("metric_name"), F.lit("SUM(NUMBER)").alias("chosen_expr"))
    return Q.verify_metrics(definitions, decisions)


def _spec_list(kind: str) -> str:
    return f"string_agg(lower(c) || ': ' || d, '; ' ORDER BY ordinal) FILTER (class = '{kind}')"


@query(
    "semantic_spec",
    f"""
    WITH {_FACT_DIM},
    x AS (SELECT *, column_name AS c, regexp_replace(database_name, '(_DB|_DW|_PROD|_DEV|_STAGE|_STG)$', '') AS domain,
      CASE WHEN column_name LIKE '%\\_ID' ESCAPE '\\' OR column_name = 'ID' THEN 'key' WHEN data_type IN ('DATE', 'TIMESTAMP') THEN 'time_dimension'
           WHEN data_type IN ('NUMBER', 'FLOAT') THEN 'fact' ELSE 'dimension' END AS class FROM catalog_columns),
    y AS (SELECT *, {DESCRIBE_SQL} AS d FROM x),
    l AS (SELECT database_name, left_table, count(*) AS n FROM fd GROUP BY 1, 2),
    v AS (SELECT upper(domain) AS domain, count(*) AS n FROM query_log WHERE question <> '' AND NOT regexp_matches(upper(query_text), 'CREATE|UPDATE|DELETE')
          AND domain <> '' GROUP BY 1)
    SELECT 'sv_' || lower(y.domain) AS name, {_FQN.replace("database_name", "y.database_name")} AS base_table, lower(table_name) AS logical_table,
      {_spec_list("dimension")} AS dimensions, {_spec_list("time_dimension")} AS time_dimensions, {_spec_list("fact")} AS facts,
      coalesce(any_value(l.n), 0) AS relationships, coalesce(any_value(v.n), 0) AS verified_queries
    FROM y LEFT JOIN l ON l.database_name = y.database_name AND l.left_table = lower(table_name) LEFT JOIN v ON v.domain = y.domain
    GROUP BY y.domain, y.database_name, schema_name, table_name
    """,
    ("catalog_columns", "query_log"),
)
def _(t):
    verified = X.verified_queries(t.query_log).withColumn("domain", F.upper("domain"))
    columns = t.catalog_columns.withColumn("domain", domain_of("database_name"))
    return Q.semantic_spec(columns, R.fact_dim_relations(t.catalog_columns, counted=True), verified)


_SPEC_DOMAIN = "regexp_replace(database_name, '(_DB|_DW|_PROD|_DEV|_STAGE|_STG)$', '')"


def _domain_columns(t):
    return t.catalog_columns.withColumn("domain", domain_of("database_name"))


@query(
    "spec_metrics",
    f"""
    WITH x AS (SELECT *, {_SPEC_DOMAIN} AS domain FROM catalog_columns),
    m AS (SELECT domain, 'avg_' || lower(table_name) || '_' || lower(column_name) AS metric_name, 'AVG(' || column_name || ')' AS expr FROM x WHERE data_type = 'FLOAT'
          UNION SELECT upper(domain), lower(regexp_extract(query_text, '(?i)JOIN\\s+\\w+\\.\\w+\\.(\\w+)', 1)) || '_joins', 'COUNT(1)' FROM query_log),
    s AS (SELECT DISTINCT domain, {_FQN} AS base_table, lower(table_name) AS logical_table FROM x)
    SELECT DISTINCT 'sv_' || lower(s.domain) AS name, base_table, logical_table, metric_name, expr, CAST(NULL AS VARCHAR) AS description
    FROM s JOIN m ON m.domain = s.domain AND contains(metric_name, logical_table)
    """,
    ("catalog_columns", "query_log"),
)
def _(t):
    columns = _domain_columns(t)
    low = F.concat(F.lit("avg_"), F.lower("table_name"), F.lit("_"), F.lower("column_name"))
    own = columns.filter("data_type = 'FLOAT'").select("domain", low.alias("metric_name"), F.concat(F.lit("AVG("), "column_name", F.lit(")")).alias("expr"))
    joined = F.concat(F.lower(F.regexp_extract("query_text", r"(?i)JOIN\s+\w+\.\w+\.(\w+)", 1)), F.lit("_joins"))
    asked = t.query_log.select(F.upper("domain").alias("domain"), joined.alias("metric_name"), F.lit("COUNT(1)").alias("expr"))
    return Q.spec_metrics(columns, own.unionByName(asked).distinct())


@query(
    "spec_relations",
    f"""WITH {_FACT_DIM}, o AS (SELECT DISTINCT database_name, {_SPEC_DOMAIN} AS domain FROM catalog_columns)
    SELECT 'sv_' || lower(domain) AS name, fd.name AS relation, database_name, left_table, right_table, relationship_columns FROM fd JOIN o USING (database_name)""",
    ("catalog_columns",),
)
def _(t):
    return Q.spec_relations(_domain_columns(t), R.fact_dim_relations(t.catalog_columns))


@query(
    "spec_verified",
    f"""WITH o AS (SELECT DISTINCT {_SPEC_DOMAIN} AS domain FROM catalog_columns)
    SELECT 'sv_' || lower(domain) AS name, 'vqr_' || CAST(query_id AS VARCHAR) AS query_name, question, query_text AS sql,
      row_number() OVER (PARTITION BY domain ORDER BY query_id) <= 5 AS use_as_onboarding_question
    FROM (SELECT * REPLACE (upper(domain) AS domain) FROM query_log) JOIN o USING (domain)
    WHERE question <> '' AND query_text <> '' AND NOT regexp_matches(upper(query_text), 'CREATE|UPDATE|DELETE')""",
    ("catalog_columns", "query_log"),
)
def _(t):
    return Q.spec_verified(_domain_columns(t), X.verified_queries(t.query_log).withColumn("domain", F.upper("domain")))


@query(
    "regression_checks",
    """
    WITH w AS (SELECT unnest(['SALES', 'OPS', 'NOWHERE']) AS domain)
    SELECT domain, 'domain_exists' AS test_name, CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END AS status, 'count=' || CAST(n AS VARCHAR) AS detail
    FROM (SELECT w.domain, count(c.domain) AS n FROM w LEFT JOIN concepts c USING (domain) GROUP BY 1)
    UNION ALL SELECT domain, 'query_plane_tables_present', 'INFO', 'meta_db=' || domain || '_META' FROM w
    """,
    ("catalog_tables", "concepts"),
)
def _(t):
    return Q.regression_checks(t.concepts.select("domain"), ["SALES", "OPS", "NOWHERE"])
