"""Queries on repeated runs, rule selection and graph views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exact import as_large
from tidemark.operators import catalog as K
from tidemark.operators import consistency as P
from tidemark.operators import ontology as O
from tidemark.operators import rules as L
from tidemark.plans.inputs import pick
from tidemark.plans.oracle_inputs import pick as sql_pick
from tidemark.plans.registry import query

_FQN = "database_name || '.' || schema_name || '.' || table_name"
_RUNS = [1, 2, 3]


def plan_objects(t):
    """Catalog tables as the objects of one build plan per database, in three runs that differ a little."""
    s, k = F.col("size_code"), F.col("part_key")
    rows = t.catalog_tables.select("*", F.explode(F.array(*[F.lit(r) for r in _RUNS])).alias("run"))
    r = F.col("run")
    return rows.filter(~((r == 3) & (s == 7)) & ~((r == 2) & (s == 19))).select(
        F.col("database_name").alias("plan_id"), r.cast("bigint").alias("run"),
        F.when(r == 2, F.lower("table_name")).otherwise(K.full_name()).alias("name"),
        F.when((r == 3) & (s == 11), "VIEW").otherwise(F.col("table_type")).alias("object_type"),
        F.when((r == 2) & (s == 23), k + 1).otherwise(k).alias("position"),
        F.when((r == 3) & (s == 31), F.col("row_count") * 2).when((r == 2) & (s == 29), F.floor(F.col("row_count") * 0.9)).when(s > 3, F.col("row_count")).alias("row_count"),
    )


def plan_columns(t):
    c = t.catalog_columns.select("*", F.explode(F.array(*[F.lit(r) for r in _RUNS])).alias("run"))
    changed = (F.col("run") == 3) & (F.col("ordinal") == 4) & (F.col("column_name") == "REGION")
    return c.select(
        F.col("database_name").alias("plan_id"), F.col("run").cast("bigint").alias("run"), F.lower("table_name").alias("name"), "ordinal", "column_name",
        F.when(changed, "NUMBER").when((F.col("run") == 2) & (F.col("data_type") == "VARCHAR"), "string").otherwise(F.col("data_type")).alias("data_type"),
    )


def plan_items(t, column: str):
    c = t.catalog_columns.select("*", F.explode(F.array(*[F.lit(r) for r in _RUNS])).alias("run"))
    keep = ~((F.col("run") == 2) & (F.length(column) % 4 == 0)) & ~((F.col("run") == 3) & (F.length(column) % 5 == 0))
    return c.filter(keep).select(F.col("database_name").alias("plan_id"), F.col("run").cast("bigint").alias("run"), F.col(column).alias("item")).distinct()


_PLAN = f"""rr AS (SELECT unnest([1, 2, 3]) AS run),
  po AS (SELECT database_name AS plan_id, run, table_name AS name, CASE WHEN run = 3 AND size_code = 11 THEN 'VIEW' ELSE table_type END AS object_type,
    CASE WHEN run = 2 AND size_code = 23 THEN part_key + 1 ELSE part_key END AS position,
    CASE WHEN run = 3 AND size_code = 31 THEN row_count * 2 WHEN run = 2 AND size_code = 29 THEN CAST(floor(row_count * 0.9::DOUBLE) AS BIGINT) WHEN size_code > 3 THEN row_count END AS row_count
    FROM catalog_tables, rr WHERE NOT (run = 3 AND size_code = 7) AND NOT (run = 2 AND size_code = 19)),
  pc AS (SELECT database_name AS plan_id, run, upper(table_name) AS name, ordinal, column_name, CASE WHEN run = 3 AND ordinal = 4 AND column_name = 'REGION' THEN 'NUMBER'
    WHEN data_type = 'TIMESTAMP' THEN 'TIMESTAMP_NTZ' ELSE data_type END AS data_type FROM catalog_columns, rr)"""


def _item_sql(name: str, column: str) -> str:
    return f"""{name} AS (SELECT plan_id, avg(CASE n WHEN 3 THEN 1.0::DOUBLE WHEN 2 THEN 0.5 ELSE 0 END) AS v FROM (
      SELECT database_name AS plan_id, {column}, count(DISTINCT run) AS n FROM catalog_columns, rr
      WHERE NOT (run = 2 AND length({column}) % 4 = 0) AND NOT (run = 3 AND length({column}) % 5 = 0) GROUP BY 1, 2) GROUP BY 1)"""


_CONV = f"""{_PLAN}, {_item_sql("ft", "data_type")}, {_item_sql("ar", "column_name")},
  ob AS (SELECT plan_id, avg(CASE n WHEN 3 THEN 1.0::DOUBLE WHEN 2 THEN 0.5 ELSE 0 END) AS v FROM (SELECT plan_id, name, object_type, count(DISTINCT run) AS n FROM po GROUP BY 1, 2, 3) GROUP BY 1),
  th AS (SELECT plan_id, run, name, string_agg(column_name || '|' || data_type, ';' ORDER BY ordinal) AS h FROM pc GROUP BY 1, 2, 3),
  st AS (SELECT plan_id, avg(CASE m WHEN 3 THEN 1.0::DOUBLE WHEN 2 THEN 0.5 ELSE 0 END) AS v FROM (SELECT plan_id, name, max(c) AS m, sum(c) AS n FROM (SELECT plan_id, name, h, count(*) AS c FROM th GROUP BY 1, 2, 3) GROUP BY 1, 2) WHERE n >= 2 GROUP BY 1),
  sq AS (SELECT plan_id, CASE WHEN bool_and(n = 3) AND bool_and(same) THEN 1.0::DOUBLE WHEN bool_and(n = 3) THEN 0.5 ELSE 0 END AS v FROM (SELECT plan_id, name, count(DISTINCT run) AS n, min(position) = max(position) AS same FROM po GROUP BY 1, 2) GROUP BY 1),
  rc AS (SELECT plan_id, avg(CASE WHEN lo = hi THEN 1.0::DOUBLE WHEN hi - lo <= hi * 0.2::DOUBLE THEN 0.75 ELSE 0 END) AS v FROM (SELECT plan_id, name, count(*) AS n, min(row_count) AS lo, max(row_count) AS hi FROM po WHERE row_count IS NOT NULL GROUP BY 1, 2) WHERE n >= 2 GROUP BY 1),
  cv AS (SELECT plan_id, round(ob.v, 4) AS objects, round(st.v, 4) AS structure, round(sq.v, 4) AS sequence, round(rc.v, 4) AS row_counts, round(ft.v, 4) AS features, round(ar.v, 4) AS artifacts,
    round(ob.v * 20 + st.v * 30 + sq.v * 15 + rc.v * 10 + ft.v * 15 + ar.v * 10, 1) AS convergence FROM ob JOIN st USING (plan_id) JOIN sq USING (plan_id) JOIN rc USING (plan_id) JOIN ft USING (plan_id) JOIN ar USING (plan_id))"""
_CU = ("catalog_tables", "catalog_columns")


def _conv(t):
    return P.convergence(plan_objects(t), plan_columns(t), plan_items(t, "data_type"), plan_items(t, "column_name"))


@query("convergence", f"WITH {_CONV} SELECT * FROM cv", _CU)
def _(t):
    return _conv(t)


@query(
    "convergence_verdict",
    f"""WITH {_CONV} SELECT plan_id, convergence, CASE WHEN convergence >= 90 THEN 'DETERMINISTIC' WHEN convergence >= 70 THEN 'MOSTLY_DETERMINISTIC'
        WHEN convergence >= 50 THEN 'DIVERGENT' ELSE 'NON_DETERMINISTIC' END AS verdict FROM cv""",
    _CU,
)
def _(t):
    return P.convergence_verdict(_conv(t)).select("plan_id", "convergence", "verdict")


@query(
    "consensus",
    f"""WITH {_PLAN}, f AS (SELECT plan_id, name AS item, 'object_type' AS field, run, object_type AS value FROM po UNION ALL SELECT plan_id, name, 'row_count', run, CAST(row_count AS VARCHAR) FROM po WHERE row_count IS NOT NULL),
    v AS (SELECT plan_id, item, field, value, count(*) AS n, min(run) AS r FROM f GROUP BY 1, 2, 3, 4)
    SELECT plan_id, item, field, value, max(n) OVER (PARTITION BY plan_id, item, field) AS votes FROM v
    QUALIFY row_number() OVER (PARTITION BY plan_id, item, field ORDER BY CASE WHEN n >= 2 THEN n ELSE 1 END DESC, r) = 1""",
    _CU,
)
def _(t):
    o = plan_objects(t).withColumn("item", P.core_name(F.col("name")))
    one = lambda f, c: o.filter(c.isNotNull()).select("plan_id", "item", F.lit(f).alias("field"), "run", c.cast("string").alias("value"))
    return P.consensus(one("object_type", F.col("object_type")).unionByName(one("row_count", F.col("row_count"))))


def results(t):
    """Three runs per test with a flag, a number, a rate and a text."""
    u, e = F.col("user_id"), F.col("event_id")
    g = t.table("events").select(
        F.floor(e / 3).alias("test_id"), (e % 3 + 1).alias("run"),
        F.explode(
            F.create_map(
                F.lit("completed"), (F.col("event_type") != "error").cast("string"), F.lit("object_count"), (u % 6).cast("string"),
                F.lit("pass_rate"), F.round(F.pmod(F.col("value"), F.lit(1.0)), 2).cast("string"), F.lit("output"), F.concat(F.lit("kind "), F.col("event_type")),
            )
        ).alias("field", "value"),
    )
    return g


_EXPECT = {"completed": "true", "object_count": ">= 3", "pass_rate": "< 0.5", "output": "contains: i"}


def _rules(t):
    ids = t.table("events").select(F.floor(F.col("event_id") / 3).alias("test_id")).distinct()
    return ids.select("test_id", F.explode(F.create_map(*[F.lit(x) for kv in _EXPECT.items() for x in kv])).alias("field", "expected"))


_RES = """rs AS (SELECT event_id // 3 AS test_id, event_id % 3 + 1 AS run, event_type <> 'error' AS completed, user_id % 6 AS object_count, round(value % 1.0, 2) AS pass_rate, 'kind ' || event_type AS output FROM events)"""


@query(
    "assertions",
    f"""WITH {_RES}, a AS (SELECT test_id, 'completed' AS field, 'true' AS expected, completed AS p FROM rs UNION ALL SELECT test_id, 'object_count', '>= 3', object_count >= 3 FROM rs
      UNION ALL SELECT test_id, 'pass_rate', '< 0.5', pass_rate < 0.5 FROM rs UNION ALL SELECT test_id, 'output', 'contains: i', contains(output, 'i') FROM rs)
    SELECT test_id, field, expected, count(*) AS runs, count(*) FILTER (p) AS passed_runs, CASE WHEN count(*) FILTER (p) = count(*) THEN 'PASS' WHEN count(*) FILTER (p) > 0 THEN 'WARN' ELSE 'FAIL' END AS status FROM a GROUP BY 1, 2, 3""",
)
def _(t):
    return P.assertions(results(t), _rules(t))


@query(
    "field_consistency",
    f"""WITH {_RES}, s AS (SELECT test_id, max(object_count) - min(object_count) AS a, max(pass_rate) - min(pass_rate) AS b FROM rs GROUP BY 1),
    c AS (SELECT test_id, round((CASE WHEN a = 0 THEN 1.0::DOUBLE WHEN a <= 1 THEN 0.8 WHEN a <= 2 THEN 0.5 ELSE 0 END * 0.7 + CASE WHEN b = 0 THEN 1.0::DOUBLE WHEN b <= 1 THEN 0.8 WHEN b <= 2 THEN 0.5 ELSE 0 END * 0.3) * 100, 2) AS consistency_pct FROM s)
    SELECT *, CASE WHEN consistency_pct >= 90 THEN 'EXCELLENT' WHEN consistency_pct >= 75 THEN 'GOOD' WHEN consistency_pct >= 60 THEN 'ACCEPTABLE' ELSE 'POOR' END AS band FROM c""",
)
def _(t):
    weights = t.spark.createDataFrame([("object_count", 0.7), ("pass_rate", 0.3)], "field string, weight double")
    return P.field_consistency(results(t), weights)


@query(
    "length_consistency",
    """WITH g AS (SELECT conv_id AS test_id, max(length(text)) AS hi, min(length(text)) AS lo FROM conversations GROUP BY 1),
    s AS (SELECT test_id, (hi - lo) / CAST(hi AS DOUBLE) AS sp FROM g), c AS (SELECT test_id, round(sp, 4) AS spread, CASE WHEN sp <= 0.1 THEN 100.0::DOUBLE WHEN sp <= 0.25 THEN 80.0 ELSE 50.0 END AS consistency_pct FROM s)
    SELECT *, CASE WHEN consistency_pct >= 90 THEN 'EXCELLENT' WHEN consistency_pct >= 75 THEN 'GOOD' WHEN consistency_pct >= 60 THEN 'ACCEPTABLE' ELSE 'POOR' END AS band FROM c""",
)
def _(t):
    return P.length_consistency(t.table("conversations").select(F.col("conv_id").alias("test_id"), F.col("text").alias("output")))


@query(
    "artifact_audit",
    """WITH su AS (SELECT database_name AS lab_id, table_name, column_name, row_count, size_code FROM catalog_columns JOIN catalog_tables USING (database_name, schema_name, table_name)),
    tb AS (SELECT DISTINCT lab_id, table_name, row_count, size_code FROM su),
    re AS (SELECT database_name AS lab_id, table_name, column_name FROM catalog_columns_new WHERE ordinal > 3)
    SELECT lab_id, 'MISSING_TABLE' AS finding, table_name AS item FROM (SELECT DISTINCT lab_id, 'GHOST_' || table_name AS table_name FROM re WHERE column_name = 'NOTES') UNION ALL
    SELECT DISTINCT lab_id, 'MISSING_COLUMN', table_name || '.' || column_name FROM re WHERE column_name <> 'NOTES' AND (lab_id, table_name) IN (SELECT (lab_id, table_name) FROM tb) AND (lab_id, table_name, column_name) NOT IN (SELECT (lab_id, table_name, column_name) FROM su) UNION ALL
    SELECT lab_id, 'ROW_COUNT_MISMATCH', table_name FROM tb WHERE size_code = 21 UNION ALL SELECT lab_id, 'NOT_TORN_DOWN', table_name FROM tb WHERE size_code = 8 UNION ALL
    SELECT lab_id, 'UNUSED_TABLE', table_name FROM tb WHERE (lab_id, table_name) NOT IN (SELECT (lab_id, table_name) FROM re WHERE column_name <> 'NOTES')""",
    ("catalog_tables", "catalog_columns", "catalog_columns_new"),
)
def _(t):
    lab = F.col("database_name").alias("lab_id")
    setup = t.catalog_columns.join(as_large(t.catalog_tables.select(*K.TABLE_KEY, "row_count")), K.TABLE_KEY).select(lab, "table_name", "column_name", "row_count")
    ghost = F.col("column_name") == "NOTES"
    refs = t.catalog_columns_new.filter("ordinal > 3").select(lab, F.when(ghost, F.concat(F.lit("GHOST_"), "table_name")).otherwise(F.col("table_name")).alias("table_name"), "column_name")
    tables = t.catalog_tables
    stated = tables.select(lab, "table_name", (F.col("row_count") + F.when(F.col("size_code") == 21, 1).otherwise(0)).alias("row_count"))
    return P.artifact_audit(setup, refs, stated, tables.filter("size_code <> 8").select(lab, "table_name"))


# ---- rules ----

RULES = [
    ("governance", "directory", "rules/"), ("skills", "directory", "skills/"), ("sql-core", "extension", ".sql"), ("python-core", "extension", ".py"),
    ("markup", "extension", ".yaml"), ("markup", "extension", ".yml"), ("project", "file", "pyproject.toml"), ("readme", "file", "readme.md"),
    ("tests", "keyword", "test"), ("dashboards", "keyword", "dashboard"), ("tests", "keyword", "tests"),
]
_PHRASES = ["Fix rules/core.sql and add a test", "Write tests for my dashboard app.py", "Edit pyproject.toml, then README.md", "Look at skills/x.yaml and notes.txt", "Explain this"]


@query(
    "match_rules",
    f"""WITH q AS (SELECT conv_id * 1000 + turn AS request_id, {sql_pick(_PHRASES, "conv_id + turn")} AS p FROM conversations WHERE role = 'user'),
    m AS (SELECT * FROM (VALUES (0, 'governance', '(directory: rules/)'), (0, 'sql-core', '(file extension: .sql)'), (0, 'tests', '(keyword: test)'),
      (1, 'tests', '(keyword: tests)'), (1, 'dashboards', '(keyword: dashboard)'), (1, 'python-core', '(file extension: .py)'),
      (2, 'project', '(file: pyproject.toml)'), (2, 'readme', '(file: readme.md)'), (2, NULL, 'No domain rule for .toml'), (2, NULL, 'No domain rule for .md'),
      (3, 'skills', '(directory: skills/)'), (3, 'markup', '(file extension: .yaml)'), (3, NULL, 'No domain rule for .txt')) v(i, rule, reason))
    SELECT request_id, 'core' AS rule, '(foundation)' AS reason FROM q
    UNION ALL SELECT request_id, rule, reason FROM q JOIN m ON {sql_pick(_PHRASES, "i")} = p""",
)
def _(t):
    k = F.col("conv_id")
    requests = t.table("conversations").filter("role = 'user'").select((k * 1000 + F.col("turn")).alias("request_id"), pick(_PHRASES, k + F.col("turn")).alias("text"))
    return L.match_rules(requests, t.spark.createDataFrame(RULES, "rule string, kind string, token string"), "core")


_TIERS = ["critical", "high", "medium", "low"]


@query(
    "budget_select",
    f"""WITH s AS (SELECT part_key // 8 AS request_id, table_name AS rule, (size_code * 90) AS tokens, {sql_pick(_TIERS, "part_key + size_code")} AS tier, size_code % 2 = 0 AS is_related FROM catalog_tables),
    o AS (SELECT *, CASE WHEN tier = 'critical' THEN 0 WHEN tier = 'medium' AND is_related THEN 1 WHEN tier = 'high' THEN 2 WHEN tier = 'medium' THEN 3 ELSE 4 END AS o FROM s),
    r AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY request_id) AS BIGINT) AS total_tokens, sum(tokens) OVER (PARTITION BY request_id ORDER BY o, rule ROWS UNBOUNDED PRECEDING) AS run FROM o)
    SELECT request_id, rule, tokens, total_tokens, CASE WHEN total_tokens <= 20000 OR o <= 1 THEN 'LOAD' WHEN tier = 'low' THEN 'DEFER' WHEN run <= 20000 THEN 'LOAD' ELSE 'DEFER' END AS decision,
      CASE WHEN total_tokens > 20000 THEN 'OVER' WHEN total_tokens > 15000 THEN 'WARNING' ELSE 'OK' END AS budget FROM r""",
    ("catalog_tables",),
)
def _(t):
    s, k = F.col("size_code"), F.col("part_key")
    selected = t.catalog_tables.select(
        F.floor(k / 8).alias("request_id"), F.col("table_name").alias("rule"), (s * 90).alias("tokens"), pick(_TIERS, k + s).alias("tier"), (s % 2 == 0).alias("is_related")
    )
    return L.budget_select(selected)


# ---- graph views ----

def _nodes(t):
    c = O.class_nodes(t.table("customer"), "Customer", "c_custkey", {"c_name": "name", "c_mktsegment": "segment", "c_custkey": "key", "c_nationkey": "nation"})
    s = O.class_nodes(t.table("supplier"), "Supplier", "s_suppkey", {"s_name": "name", "s_suppkey": "key", "s_nationkey": "nation"})
    n = O.class_nodes(t.table("nation"), "Nation", "n_nationkey", {"n_name": "name", "n_nationkey": "key"})
    return c, s, n


def _edges(t):
    c, s, n = _nodes(t)
    on = F.col("l.nation") == F.col("r.key")
    return O.relation_edges(c, n, on, "LIVES_IN").unionByName(O.relation_edges(s, n, on, "BASED_IN"))


_NODES = """nodes AS (SELECT 'Customer:' || c_custkey AS node_id, 'Customer' AS node_type, c_name AS name, c_mktsegment AS segment, c_custkey AS key, c_nationkey AS nation FROM customer
    UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier', s_name, NULL, s_suppkey, s_nationkey FROM supplier UNION ALL SELECT 'Nation:' || n_nationkey, 'Nation', n_name, NULL, n_nationkey, NULL FROM nation),
  edges AS (SELECT 'Customer:' || c_custkey AS src_id, 'Nation:' || n_nationkey AS dst_id, 'LIVES_IN' AS relation FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'Supplier:' || s_suppkey, 'Nation:' || n_nationkey, 'BASED_IN' FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query("class_nodes", f"WITH {_NODES} SELECT node_id, node_type, name, segment, key, nation FROM nodes WHERE node_type = 'Customer'")
def _(t):
    return _nodes(t)[0]


@query("relation_edges", f"WITH {_NODES} SELECT * FROM edges")
def _(t):
    return _edges(t)


@query("abstract_class", f"WITH {_NODES} SELECT node_id, node_type, name, segment, 'Party' AS abstract_class FROM nodes WHERE node_type <> 'Nation'")
def _(t):
    c, s, _n = _nodes(t)
    return O.abstract_class({"c": c, "s": s}, "Party").select("node_id", "node_type", "name", "segment", "abstract_class")


@query(
    "generic_nodes",
    f"""WITH {_NODES} SELECT node_id, node_type, '{{"name":"' || name || '","key":' || key || ',"nation":' || nation || '}}' AS properties FROM nodes WHERE node_type = 'Supplier'""",
)
def _(t):
    return O.generic_nodes(_nodes(t)[1])


@query(
    "generic_edges",
    f"""SELECT src_id, dst_id, relation, CAST(count(*) AS DOUBLE) AS weight, sha256(src_id || '|' || relation || '|' || dst_id) AS edge_id
        FROM (SELECT 'Part:' || l_partkey AS src_id, 'Supplier:' || l_suppkey AS dst_id, 'SUPPLIED_BY' AS relation FROM lineitem) GROUP BY 1, 2, 3""",
)
def _(t):
    e = t.table("lineitem").select(
        F.concat_ws(":", F.lit("Part"), F.col("l_partkey").cast("string")).alias("src_id"), F.concat_ws(":", F.lit("Supplier"), F.col("l_suppkey").cast("string")).alias("dst_id"), F.lit("SUPPLIED_BY").alias("relation")
    )
    return O.generic_edges(e)


@query(
    "graph_stats",
    f"""WITH {_NODES} SELECT 'total_nodes' AS stat, count(*) AS value FROM nodes UNION ALL SELECT 'total_classes', count(DISTINCT node_type) FROM nodes
        UNION ALL SELECT 'total_edges', count(*) FROM edges UNION ALL SELECT 'total_relations', count(DISTINCT relation) FROM edges""",
)
def _(t):
    c, s, n = _nodes(t)
    return O.graph_stats(O.abstract_class({"c": c, "s": s, "n": n}, "Thing"), _edges(t))


@query(
    "view_health",
    f"""WITH {_NODES}, w AS (SELECT unnest(['Customer', 'Supplier', 'Nation', 'Region']) AS node_type)
    SELECT node_type, count(node_id) AS row_count, CASE WHEN count(node_id) > 0 THEN 'OK' ELSE 'EMPTY' END AS status FROM w LEFT JOIN nodes USING (node_type) GROUP BY 1""",
)
def _(t):
    c, s, n = _nodes(t)
    return O.view_health(O.abstract_class({"c": c, "s": s, "n": n}, "Thing"), ["Customer", "Supplier", "Nation", "Region"])


@query(
    "intake_gate",
    """WITH d AS (SELECT domain, count(*) FILTER (is_active) AS n, bool_or(has_joins) AS r, domain <> 'WEB' AS c, CASE WHEN domain <> 'OPS' THEN CASE WHEN count(*) % 3 > 0 THEN 'ACTIVE' ELSE 'BUILDING' END END AS i, CASE WHEN count(*) % 4 = 3 THEN 'NEW' ELSE 'ENRICHED' END AS s FROM concepts GROUP BY 1),
    x AS (SELECT domain, concat_ws(',', CASE WHEN n < 3 THEN 'concepts' END, CASE WHEN NOT r THEN 'relations' END, CASE WHEN NOT c THEN 'config' END, CASE WHEN coalesce(i, '') <> 'ACTIVE' THEN 'index' END, CASE WHEN s = 'NEW' THEN 'status' END) AS failed_checks FROM d)
    SELECT *, CASE WHEN failed_checks = '' THEN 'PASS' ELSE 'STOP' END AS gate FROM x""",
    ("catalog_tables", "concepts"),
)
def _(t):
    n = F.count(F.lit(1))
    d = t.concepts.groupBy("domain").agg(
        F.count_if("is_active").alias("concept_count"), F.bool_or("has_joins").alias("has_relations"), F.when(n % 3 > 0, "ACTIVE").otherwise("BUILDING").alias("_i"),
        F.when(n % 4 == 3, "NEW").otherwise("ENRICHED").alias("status"),
    )
    return O.intake_gate(d.withColumns({"has_config": F.col("domain") != "WEB", "index_status": F.when(F.col("domain") != "OPS", F.col("_i"))}))
