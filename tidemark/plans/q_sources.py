"""Queries over files written from the tables, transcripts and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exact import one_row
from tidemark.operators import sqlmining as X
from tidemark.plans.inputs import pick
from tidemark.plans.oracle_inputs import pick as sql_pick
from tidemark.plans.q_sqlmining import TABLES
from tidemark.plans.registry import query
from tidemark.session import scratch_folder
from tidemark.sources import query_files as S
from tidemark.sources import runs as R
from tidemark.sources import transcripts as T

_EPOCH = 1706659200.0  # 2024-01-31 in seconds


def _csv(t, folder):
    q = t.query_log.select(F.when(F.col("query_id") % 10 != 9, F.concat(F.lit("  "), F.col("query_text"))).alias("SQL"), F.col("question").alias("Question"), F.col("domain").alias("Domain"))
    q.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(folder)


@query(
    "read_query_csv",
    """SELECT md5(trim(query_text, ' ')) AS sql_hash, question, domain, count(*) AS query_count FROM query_log WHERE query_id % 10 <> 9 GROUP BY 1, 2, 3""",
    ("query_log",),
)
def _(t):
    folder = scratch_folder(t.spark)
    _csv(t, folder)
    m = F.col("metadata")
    return S.read_query_csv(t.spark, folder).groupBy(F.md5("sql").alias("sql_hash"), m["Question"].alias("question"), m["Domain"].alias("domain")).agg(F.count(F.lit(1)).alias("query_count"))


def json_arrays(t):
    """Queries in files of one JSON array each, texts and objects mixed, some without SQL."""
    k = F.col("query_id")
    obj = F.to_json(F.struct(F.when(k % 3 == 1, F.col("query_text")).alias("sql"), F.when(k % 3 >= 1, F.col("domain")).alias("domain")))
    bare = F.expr("substring(to_json(struct(query_text as x)), 6, length(to_json(struct(query_text as x))) - 6)")
    item = F.when(k % 3 == 0, bare).otherwise(obj)
    return t.query_log.groupBy(F.floor(k / 500).alias("bucket")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("value"))


@query(
    "read_query_json",
    """SELECT CASE WHEN query_id % 3 = 1 THEN domain END AS domain, md5(query_text) AS sql_hash, count(*) AS query_count FROM query_log WHERE query_id % 3 < 2 GROUP BY 1, 2""",
    ("query_log",),
)
def _(t):
    folder = scratch_folder(t.spark)
    json_arrays(t).repartition("bucket").write.partitionBy("bucket").text(folder)
    found = S.read_query_json(t.spark, folder, recursive=True, glob="*.txt")
    return found.groupBy(F.col("metadata")["domain"].alias("domain"), F.md5("sql").alias("sql_hash")).agg(F.count(F.lit(1)).alias("query_count"))


@query(
    "read_query_sql",
    "SELECT md5(arg_max(query_text, query_id) || chr(10)) AS sql_hash, CAST(1 AS BIGINT) AS has_path FROM query_log GROUP BY user_name",
    ("query_log",),
)
def _(t):
    folder = scratch_folder(t.spark)
    last = t.query_log.groupBy("user_name").agg(F.max_by("query_text", "query_id").alias("value"))
    last.repartition("user_name").write.partitionBy("user_name").text(folder)
    found = S.read_query_sql(t.spark, folder, recursive=True, glob="*.txt")
    return found.select(F.md5("sql").alias("sql_hash"), F.col("metadata")["file"].contains("user_name=").cast("bigint").alias("has_path"))


@query(
    "write_documents",
    """SELECT skipped, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tables FROM (
         SELECT query_id % 12 IN (1, 4, 8) AS skipped, CASE query_id % 12 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 0 WHEN 7 THEN 3 WHEN 8 THEN 0 WHEN 10 THEN 3 ELSE 1 END
           - CASE WHEN query_id % 12 IN (0, 3) AND t1 = t2 THEN 1 WHEN query_id % 12 = 7 AND t1 = t2 THEN 1 WHEN query_id % 12 = 10 THEN 3 - len(list_distinct([t1, t2, t3])) ELSE 0 END AS n
         FROM (SELECT query_id, o_custkey % 200 AS t1, (o_custkey * 7 + 3) % 200 AS t2, (o_custkey * 11 + 5) % 200 AS t3 FROM query_log JOIN orders ON o_orderkey = query_id)) GROUP BY 1""",
    ("query_log",),
)
def _(t):
    folder = scratch_folder(t.spark)
    S.write_documents(S.query_documents(X.process_queries(t.query_log)), folder)
    back = t.spark.read.schema("index bigint, skipped boolean, reason string, tables array<string>").json(folder)
    return back.groupBy("skipped").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("tables")).alias("tables"))


@query(
    "write_extraction",
    f"""WITH {TABLES}, u AS (SELECT DISTINCT t, cls, query_id FROM tabs)
    SELECT cls || '_tables' AS "group", t AS "table", count(*) AS used_in, min(query_id) AS first_query, max(query_id) AS last_query,
      (SELECT count(DISTINCT t) FROM tabs) AS unique_tables, (SELECT count(*) FROM clean WHERE NOT w) AS processed FROM u GROUP BY 1, 2""",
    ("query_log",),
)
def _(t):
    folder = scratch_folder(t.spark)
    done = X.process_queries(t.query_log)
    S.write_extraction(done, X.extraction_summary(done), X.table_usage(done), folder)
    total = t.spark.read.schema("summary struct<unique_tables bigint, processed bigint>").json(f"{folder}/summary").select("summary.*")
    back = t.spark.read.schema("group string, `table` string, used_in_queries array<bigint>").json(f"{folder}/consolidated")
    q = F.col("used_in_queries")
    tables = back.groupBy("group", "table").agg(F.sum(F.size(q)).alias("used_in"), F.min(F.array_min(q)).alias("first_query"), F.max(F.array_max(q)).alias("last_query"))
    return tables.withColumn("_s", one_row(total)).select(*tables.columns, "_s.unique_tables", "_s.processed")


@query(
    "read_completed_runs",
    """SELECT run_id, skill_name, duration_seconds FROM timing_runs WHERE skill_name = 'plan-reviewer' AND mode = 'FULL' AND epoch_us(started) / 1000000.0 >= 1706659200 - 20 * 86400""",
    ("timing_runs",),
)
def _(t):
    folder = scratch_folder(t.spark)
    end = (F.unix_micros(F.col("started").cast("timestamp")) / 1_000_000.0).alias("end_epoch")
    t.timing_runs.select("run_id", "skill_name", F.col("mode").alias("review_mode"), "model", end, "duration_seconds", F.lit("completed").alias("status")).write.json(folder)
    t.timing_runs.select(F.concat(F.lit("{broken "), "run_id").alias("value")).write.mode("append").text(folder)
    return R.read_completed_runs(t.spark, folder, _EPOCH, 20, skill="plan-reviewer", mode="FULL").select("run_id", "skill_name", "duration_seconds")


@query(
    "read_catalog_snapshot",
    """WITH l AS (SELECT * FROM catalog_tables WHERE size_code <> 44 AND schema_name <> 'RAW')
    SELECT 'databases' AS relation, count(DISTINCT database_name) AS row_count FROM l UNION ALL SELECT 'schemata', count(DISTINCT database_name || schema_name) FROM l
    UNION ALL SELECT 'tables', count(*) FROM l UNION ALL SELECT 'columns', count(*) FROM catalog_columns SEMI JOIN l USING (database_name, schema_name, table_name)
    UNION ALL SELECT 'constraints', count(*) FROM constraints SEMI JOIN l USING (database_name, schema_name, table_name)""",
    ("catalog_tables", "catalog_columns", "constraints"),
)
def _(t):
    parts = R.read_catalog_snapshot(t.catalog_tables.withColumn("is_deleted", F.col("size_code") == 44), t.catalog_columns, t.constraints, ["raw"])
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("relation"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "infer_schema",
    """SELECT CAST(p AS BIGINT) AS position, c AS column_name, d AS data_type, true AS nullable FROM (VALUES (1, 'event_id', 'bigint'), (2, 'event_type', 'string'),
        (3, 'props', 'struct<k:bigint>'), (4, 'value', 'double')) v(p, c, d)""",
)
def _(t):
    folder = scratch_folder(t.spark)
    t.table("events").select("event_id", "event_type", F.from_json("props", "k bigint").alias("props"), "value").write.json(folder)
    return R.infer_schema(t.spark, folder)


@query(
    "dataset_diff",
    """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_custkey = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_totalprice > 1500),
    h AS (SELECT sha256(length(o_orderkey::VARCHAR) || ':' || o_orderkey || length(o_orderstatus) || ':' || o_orderstatus) AS row_hash, count(*) AS n FROM a GROUP BY 1), g AS (SELECT sha256(length(o_orderkey::VARCHAR) || ':' || o_orderkey || length(o_orderstatus) || ':' || o_orderstatus) AS row_hash, count(*) AS n FROM orders GROUP BY 1),
    b AS (SELECT row_hash, coalesce(h.n, 0) AS test_count, coalesce(g.n, 0) AS baseline_count FROM h FULL JOIN g USING (row_hash))
    SELECT 'TOTAL' AS row_hash, CAST(sum(test_count) AS BIGINT) AS test_count, CAST(sum(baseline_count) AS BIGINT) AS baseline_count FROM b
    UNION ALL (SELECT * FROM b WHERE test_count <> baseline_count)""",
)
def _(t):
    o = t.table("orders")
    status = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_custkey") == 7), "X").otherwise(F.col("o_orderstatus"))
    test = o.filter("o_totalprice > 1500").select("o_orderkey", status.alias("o_orderstatus"))
    return R.dataset_diff(test, o.select("o_orderkey", "o_orderstatus"))


def telemetry(t):
    """Nested JSON with mixed types and rare keys, from the event columns."""
    e, u = F.col("event_id"), F.col("user_id")
    user = F.struct(u.alias("id"), F.struct(F.col("event_type").alias("kind"), F.struct((e % 2).alias("deep")).alias("more")).alias("info"))
    tags = F.array(F.col("event_type"), F.lit("t"))
    plain = F.to_json(F.struct(e.alias("id"), user.alias("user"), F.when(e % 3 > 0, tags).alias("tags"), F.when(u % 50 == 0, F.lit(1)).alias("rare")))
    mixed = F.when(e % 4 == 0, F.regexp_replace(plain, r"^\{", '{"flag":true,')).otherwise(F.regexp_replace(plain, r"^\{", '{"flag":"x",'))
    return t.table("events").select(mixed.alias("body"))


@query(
    "json_paths",
    """WITH e AS (SELECT event_id AS e, user_id AS u FROM events),
    p AS (SELECT '.flag' AS path, 'BOOLEAN' AS value_type, count(*) FILTER (e % 4 = 0) AS occurrences, 1 AS depth FROM e UNION ALL SELECT '.flag', 'STRING', count(*) FILTER (e % 4 > 0), 1 FROM e
      UNION ALL SELECT '.id', 'BIGINT', count(*), 1 FROM e UNION ALL SELECT '.user', 'OBJECT', count(*), 1 FROM e UNION ALL SELECT '.tags', 'ARRAY', count(*) FILTER (e % 3 > 0), 1 FROM e
      UNION ALL SELECT '.rare', 'BIGINT', count(*) FILTER (u % 50 = 0), 1 FROM e UNION ALL SELECT '.user.id', 'BIGINT', count(*), 2 FROM e UNION ALL SELECT '.user.info', 'OBJECT', count(*), 2 FROM e
      UNION ALL SELECT '.tags[]', 'STRING', 2 * count(*) FILTER (e % 3 > 0), 2 FROM e UNION ALL SELECT '.user.info.kind', 'STRING', count(*), 3 FROM e UNION ALL SELECT '.user.info.more', 'OBJECT', count(*), 3 FROM e
      UNION ALL SELECT '.user.info.more.deep', 'BIGINT', count(*), 4 FROM e)
    SELECT path, value_type, occurrences, CAST(depth AS BIGINT) AS depth FROM p WHERE occurrences > 0""",
)
def _(t):
    return R.json_paths(telemetry(t), "body")


# ---- transcripts ----

_TOOLS = ["sql_tool", "search_tool", "chart_tool"]


def transcript_lines(t):
    """Each conversation as the event lines of one reply, with a broken line and a done marker."""
    n, turn = F.length("text"), F.col("turn")
    name = pick(_TOOLS, n)
    use = F.concat(F.lit("data: "), F.to_json(F.struct(name.alias("name"), F.lit("tool").alias("type"), F.concat(F.lit("t"), n.cast("string")).alias("tool_use_id"))))
    result = F.concat(
        F.lit('data: {"content":[{"json":'),
        F.when(n % 3 == 0, '{"sql":"SELECT 1","result_set":{"data":[1,2,3,4,5,6,7]}}').when(n % 3 == 1, '{"search_results":[{"a":1},{"a":2}]}').otherwise('{"note":"x"}'), F.lit("},7]}"),
    )
    delta = F.concat(F.lit("data: "), F.to_json(F.struct(F.left("text", F.lit(20)).alias("text"))))
    spoken = F.when(F.col("conv_id") % 4 == 0, F.lit("event: response.text")).otherwise(F.lit("event: response.text.delta"))
    mine = F.array(
        F.when(n % 2 == 0, F.lit("event: response.tool_use")), F.when(n % 2 == 0, use), F.when(n % 2 == 0, F.lit("event: response.tool_result")), F.when(n % 2 == 0, result),
        spoken, delta, F.lit("data: {broken"), F.when(turn >= 6, F.lit("data: [DONE]")),
    )
    lines = t.table("conversations").filter("role = 'assistant'").select(F.col("conv_id").alias("run_id"), "turn", F.posexplode(F.array_compact(mine)).alias("pos", "line"))
    return lines.select("run_id", (F.col("turn") * 100 + F.col("pos")).alias("line_no"), "line")


_LINES = f"""ln AS (SELECT conv_id AS run_id, turn, length(text) AS n, {sql_pick(_TOOLS, "length(text)")} AS tool, left(text, 20) AS piece, conv_id % 4 = 0 AS whole
    FROM conversations c WHERE role = 'assistant' AND turn <= coalesce((SELECT min(turn) FROM conversations d WHERE d.conv_id = c.conv_id AND d.role = 'assistant' AND d.turn >= 6), 1000))"""


def _events(t):
    return T.typed_lines(transcript_lines(t))


@query(
    "tool_uses",
    f"""WITH {_LINES} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY turn) AS sequence, tool AS tool_name, 'tool' AS tool_type, 't' || n AS tool_use_id FROM ln WHERE n % 2 = 0""",
)
def _(t):
    return T.tool_uses(_events(t))


@query(
    "tool_results",
    f"""WITH {_LINES} SELECT run_id, turn * 100 + 3 AS line_no, CASE n % 3 WHEN 0 THEN 'analyst' WHEN 1 THEN 'search' ELSE 'other' END AS result_type, CASE WHEN n % 3 = 0 THEN 'SELECT 1' END AS sql,
        CAST(CASE n % 3 WHEN 0 THEN 7 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS items_kept FROM ln WHERE n % 2 = 0""",
)
def _(t):
    return T.tool_results(_events(t))


@query(
    "tool_result_items",
    f"""WITH {_LINES}, i AS (SELECT run_id, turn * 100 + 3 AS line_no, n, unnest(range(CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)) AS k FROM ln WHERE n % 2 = 0)
    SELECT run_id, line_no, CASE n % 3 WHEN 0 THEN 'analyst' WHEN 1 THEN 'search' ELSE 'other' END AS result_type, k + 1 AS position,
      CASE n % 3 WHEN 0 THEN CAST(k + 1 AS VARCHAR) WHEN 1 THEN '{{"a":' || (k + 1) || '}}' ELSE '{{"note":"x"}}' END AS item FROM i""",
)
def _(t):
    return T.tool_result_items(_events(t))


@query(
    "parse_agent_events",
    f"""WITH {_LINES} SELECT run_id, CASE WHEN bool_or(whole) THEN arg_min(piece, turn) ELSE string_agg(piece, '' ORDER BY turn) END AS answer FROM ln GROUP BY 1""",
)
def _(t):
    lines = transcript_lines(t)
    return T.answers(lines, T.typed_lines(lines))


def _runs(t):
    return transcript_lines(t).select("run_id").distinct().withColumn("error", F.when(F.col("run_id") % 10 == 3, "HTTP 500"))


@query(
    "batch_summary",
    f"""WITH {_LINES}, r AS (SELECT run_id, count(*) FILTER (n % 2 = 0) AS u FROM ln GROUP BY 1)
    SELECT CASE WHEN run_id % 10 = 3 THEN 'ERROR' WHEN u > 0 THEN 'OK' ELSE 'NO_TOOLS' END AS status, count(*) AS run_count FROM r GROUP BY 1""",
)
def _(t):
    return T.batch_summary(_runs(t), T.tool_uses(_events(t)))


@query("tool_counts", f"WITH {_LINES} SELECT tool AS tool_name, count(*) AS calls FROM ln WHERE n % 2 = 0 GROUP BY 1")
def _(t):
    return T.tool_counts(T.tool_uses(_events(t)))


@query(
    "response_text",
    """SELECT conv_id * 1000 + turn AS reply_id, 'run' || conv_id AS run_id, CASE WHEN turn % 2 = 1 THEN text || chr(10) || 'done' ELSE 'done' END AS answer FROM conversations WHERE role <> 'system'""",
)
def _(t):
    c, turn = F.col("conv_id"), F.col("turn")
    item = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    content = F.array(item("thinking", F.lit("hm")), F.struct(F.when(turn % 2 == 1, "text").otherwise("tool_use").alias("type"), F.col("text").alias("text")), item("text", F.lit("done")))
    body = F.to_json(F.struct(content.alias("content"), F.struct(F.concat(F.lit("run"), c.cast("string")).alias("run_id")).alias("metadata")))
    return T.response_text(t.table("conversations").filter("role <> 'system'").select((c * 1000 + turn).alias("reply_id"), body.alias("body")))
