"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evals as E
from tidemark.plans.inputs import pick
from tidemark.plans.oracle_inputs import pick as sql_pick
from tidemark.plans.registry import query

_MEAN = "CAST(sum(CAST(score AS DECIMAL(20,4))) AS DOUBLE) / count(score)"
_AC = "metric = 'answer_correctness'"
Q, S = ("eval_questions",), ("eval_scores",)


@query(
    "convert_eval",
    """
    SELECT doc_id AS test_id, source AS input_query,
      '{"ground_truth_output":"' || CASE WHEN n_chars % 5 = 0 THEN '' ELSE 'chars ' || CAST(n_chars AS VARCHAR) END || '","ground_truth_invocations":['
      || CASE WHEN n_chars % 3 = 0 THEN '' ELSE '{"tool_name":"' || lang || '","tool_sequence":1}' END || ']}' AS ground_truth
    FROM documents
    """,
)
def _(t):
    n = F.col("n_chars")
    src = t.table("documents").select(
        F.col("doc_id").alias("test_id"), F.col("source").alias("question"),
        F.when(n % 5 != 0, F.concat(F.lit("chars "), n.cast("string"))).alias("answer"), F.when(n % 3 != 0, F.col("lang")).alias("tool"),
    )
    return E.convert_eval(src)


@query(
    "validate_truth",
    """
    WITH x AS (SELECT split, ground_truth AS g, json_extract_string(ground_truth, '$.ground_truth_output') AS o FROM eval_questions)
    SELECT split, count(*) AS total, count(*) FILTER (g IS NULL) AS null_truth, count(*) FILTER (g IS NOT NULL AND o IS NULL) AS missing_output,
      count(*) FILTER (trim(o) = '') AS blank_output, count(*) FILTER (trim(o) <> '') AS valid,
      CASE WHEN count(*) FILTER (trim(o) <> '') = count(*) THEN 'PASS' ELSE 'FAIL' END AS gate FROM x GROUP BY 1
    """,
    Q,
)
def _(t):
    return E.validate_truth(t.eval_questions)


def _doc_questions(t):
    """Documents as questions: a larger set with uneven categories and splits."""
    k = F.col("doc_id")
    return t.table("documents").select(
        k.alias("test_id"), F.concat_ws("_", "source", F.when(k % 7 < 2, "rare").otherwise("main")).alias("test_category"),
        F.when(k * k % 11 < F.when(k % 20 < 5, 2).when(k % 20 < 8, 9).otherwise(4), "DEV").otherwise("TEST").alias("split"),
    )


_DOCQ = """dq AS (SELECT doc_id AS test_id, source || '_' || CASE WHEN doc_id % 7 < 2 THEN 'rare' ELSE 'main' END AS test_category,
  CASE WHEN doc_id * doc_id % 11 < CASE WHEN doc_id % 20 < 5 THEN 2 WHEN doc_id % 20 < 8 THEN 9 ELSE 4 END THEN 'DEV' ELSE 'TEST' END AS split FROM documents)"""


@query(
    "stratified_split",
    f"""
    WITH {_DOCQ}, r AS (SELECT *, row_number() OVER (PARTITION BY test_category ORDER BY md5('42:' || CAST(test_id AS VARCHAR))) AS rn,
        count(*) OVER (PARTITION BY test_category) AS n FROM dq)
    SELECT test_id, test_category, CASE WHEN rn <= round(n * 0.45) THEN 'DEV' ELSE 'TEST' END AS split FROM r
    """,
)
def _(t):
    return E.stratified_split(_doc_questions(t))


@query(
    "validate_split",
    f"""
    WITH {_DOCQ}, g AS (SELECT coalesce(test_category, 'ALL') AS test_category, count(*) AS total, count(*) FILTER (split = 'DEV') AS dev_count,
        count(*) FILTER (split = 'TEST') AS test_count, grouping(test_category) AS a FROM dq GROUP BY ROLLUP (test_category))
    SELECT test_category, total, dev_count, test_count, round(dev_count / CAST(total AS DOUBLE), 2) AS dev_ratio,
      CASE WHEN (a = 1 AND dev_count / total BETWEEN 0.40 AND 0.50) OR (a = 0 AND dev_count / total BETWEEN 0.35 AND 0.55) THEN 'PASS' ELSE 'WARN' END AS balance,
      CASE WHEN dev_count >= 3 AND test_count >= 3 THEN 'PASS' ELSE 'FAIL' END AS coverage FROM g
    """,
)
def _(t):
    return E.validate_split(_doc_questions(t))


_MOVES = """c AS (SELECT test_category, count(*) AS total, count(*) FILTER (split = 'DEV') AS before_dev FROM dq GROUP BY 1),
  mv AS (SELECT *, CAST(CASE WHEN before_dev < total * 0.35::DOUBLE THEN ceil(total * 0.35::DOUBLE) - before_dev
    WHEN before_dev > total * 0.55::DOUBLE THEN floor(total * 0.55::DOUBLE) - before_dev ELSE 0 END AS BIGINT) AS moves FROM c)"""


@query("moves_needed", f"WITH {_DOCQ}, {_MOVES} SELECT *, before_dev + moves AS after_dev FROM mv")
def _(t):
    return E.moves_needed(_doc_questions(t))


@query(
    "rebalance",
    f"""
    WITH {_DOCQ}, {_MOVES},
    p AS (SELECT *, row_number() OVER (PARTITION BY test_category, split ORDER BY md5(CAST(test_id AS VARCHAR))) AS rn FROM dq)
    SELECT test_id, test_category, p.split, CASE WHEN moves > 0 THEN 'DEV' ELSE 'TEST' END AS new_split
    FROM p JOIN mv USING (test_category) WHERE moves <> 0 AND p.split = CASE WHEN moves > 0 THEN 'TEST' ELSE 'DEV' END AND rn <= abs(moves)
    """,
)
def _(t):
    return E.rebalance(_doc_questions(t))


@query(
    "merge_small",
    f"""
    WITH {_DOCQ}, c AS (SELECT test_category, count(*) AS total, count(*) FILTER (split = 'DEV') AS dev FROM dq GROUP BY 1),
    p AS (SELECT s.test_category AS small_category, o.test_category AS target_category, levenshtein(o.test_category, s.test_category) AS edit_distance, o.total,
        o.total + s.total AS total_after, o.dev + s.dev AS dev_after FROM c s JOIN c o ON o.test_category <> s.test_category WHERE s.total < 20)
    SELECT *, round(dev_after / CAST(total_after AS DOUBLE), 4) AS dev_ratio_after, dev_after >= 3 AND total_after - dev_after >= 3 AS covered_after FROM p
    QUALIFY row_number() OVER (PARTITION BY small_category ORDER BY edit_distance, total DESC, target_category) <= 5
    """,
)
def _(t):
    return E.merge_small(_doc_questions(t), min_size=20)


@query(
    "run_means",
    f"SELECT variant, split, metric, run, round({_MEAN}, 6) AS mean_score, count(score) AS scored, count(*) FILTER (is_error) AS errors FROM eval_scores GROUP BY 1, 2, 3, 4",
    S,
)
def _(t):
    return E.run_means(t.eval_scores)


@query(
    "score_summary",
    f"SELECT variant, split, metric, round({_MEAN} * 100, 1) AS mean_pct, round(stddev_samp(score) * 100, 1) AS stddev_pct, count(score) AS n FROM eval_scores GROUP BY 1, 2, 3",
    S,
)
def _(t):
    return E.score_summary(t.eval_scores)


_PAIRED = f"""m AS (SELECT iteration, metric, run, round({_MEAN}, 6) AS v FROM eval_scores WHERE split = 'TEST' AND iteration IN (1, 2) GROUP BY 1, 2, 3),
  d AS (SELECT metric, a.v - b.v AS d FROM (SELECT * FROM m WHERE iteration = 2) a JOIN (SELECT * FROM m WHERE iteration = 1) b USING (metric, run)),
  s AS (SELECT metric, count(*) AS runs, avg(d) AS m, stddev_samp(d) AS s FROM d GROUP BY 1),
  tt AS (SELECT *, m / (s / sqrt(runs)) AS t, CASE runs WHEN 3 THEN -1.886::DOUBLE WHEN 4 THEN -1.638 WHEN 5 THEN -1.533 END AS critical FROM s),
  res AS (SELECT metric, runs, round(m, 4) AS mean_diff, round(t, 3) AS t_value, critical,
    CASE WHEN critical IS NULL THEN 'UNKNOWN' WHEN t >= critical THEN 'ACCEPT' ELSE 'REJECT' END AS decision FROM tt)"""


def _paired(t):
    s = t.eval_scores.filter("split = 'TEST'")
    means = lambda i: s.filter(F.col("iteration") == i).groupBy("metric", "run").agg(F.round(E.exact_mean("score"), 6).alias("mean_score"))
    return E.paired_t(means(2), means(1))


@query("paired_t", f"WITH {_PAIRED} SELECT * FROM res", S)
def _(t):
    return _paired(t)


@query(
    "accepted",
    f"WITH {_PAIRED} SELECT CASE WHEN count(*) FILTER (decision = 'REJECT') > 0 THEN false WHEN count(*) FILTER (decision = 'UNKNOWN') = 0 THEN bool_and(decision = 'ACCEPT') END AS is_accepted, count(*) FILTER (decision = 'REJECT') AS rejected_metrics FROM res",
    S,
)
def _(t):
    return E.accepted(_paired(t))


_VERDICTS = """vs AS (SELECT input_id, iteration * 100 + run AS run,
    CASE WHEN metric = 'logical_consistency' THEN 'factual_verdict' ELSE metric END AS metric,
    CASE WHEN metric = 'logical_consistency' THEN CASE WHEN score > 0.3 THEN 1.0::DOUBLE ELSE 0.0 END WHEN score > 0.6 THEN 1.0 ELSE score END AS score FROM eval_scores)"""


def _verdict_scores(t):
    lc = F.col("metric") == "logical_consistency"
    return t.eval_scores.select(
        "input_id", (F.col("iteration") * 100 + F.col("run")).alias("run"), F.when(lc, "factual_verdict").otherwise(F.col("metric")).alias("metric"),
        F.when(lc, F.when(F.col("score") > 0.3, 1.0).otherwise(0.0)).when(F.col("score") > 0.6, 1.0).otherwise(F.col("score")).alias("score"),
    )


@query(
    "verdict_matrix",
    f"""
    WITH {_VERDICTS}, p AS (SELECT input_id, run, max(score) FILTER ({_AC}) AS answer_correctness, max(score) FILTER (metric = 'factual_verdict') AS factual_verdict FROM vs GROUP BY 1, 2)
    SELECT *, CASE WHEN answer_correctness < 1 AND factual_verdict = 1 THEN 'FALSE_NEGATIVE' WHEN answer_correctness >= 0.67 AND factual_verdict = 0 THEN 'LENIENT_BUILTIN'
      WHEN answer_correctness < 1 AND factual_verdict = 0 THEN 'BOTH_AGREE_WRONG' WHEN answer_correctness = 1 AND factual_verdict = 1 THEN 'BOTH_AGREE_CORRECT' ELSE 'OTHER' END AS verdict_category
    FROM p WHERE answer_correctness IS NOT NULL AND factual_verdict IS NOT NULL
    """,
    S,
)
def _(t):
    return E.verdict_matrix(_verdict_scores(t))


@query(
    "append_manifest",
    """
    SELECT input_id, metric AS metric_name, score, 'flag_sweep' AS source, variant || '_' || lower(split) || '_r' || CAST(run AS VARCHAR) AS run_label,
      variant, CAST(iteration AS VARCHAR) AS iteration, 'agent' AS agent FROM eval_scores
    """,
    S,
)
def _(t):
    return E.append_manifest(t.eval_scores, "flag_sweep", None, "agent")


@query(
    "transfer_opportunities",
    f"""
    SELECT b.input_id, b.variant AS passing_variant, b.score AS passing_score, b.score_id AS passing_id, w.variant AS failing_variant,
      w.score AS failing_score, w.score_id AS failing_id, round(b.score - w.score, 4) AS gap
    FROM eval_scores b JOIN eval_scores w ON b.input_id = w.input_id AND b.variant <> w.variant
    WHERE b.{_AC} AND w.{_AC} AND b.score >= 0.8 AND w.score < 0.5 ORDER BY gap DESC, passing_score DESC, passing_id, failing_id LIMIT 20
    """,
    S,
)
def _(t):
    return E.transfer_opportunities(t.eval_scores)


@query(
    "divergent",
    f"""
    SELECT input_id, round(max(score) - min(score), 4) AS score_range, max(score) FILTER (variant = 'baseline') AS baseline,
      max(score) FILTER (variant = 'tuned') AS tuned, max(score) FILTER (variant = 'wide') AS wide
    FROM eval_scores WHERE {_AC} GROUP BY 1 HAVING round(max(score) - min(score), 4) > 0.3 ORDER BY score_range DESC, input_id LIMIT 20
    """,
    S,
)
def _(t):
    return E.divergent(t.eval_scores, ["baseline", "tuned", "wide"])


@query(
    "persistent_failures",
    f"""
    SELECT input_id, count(DISTINCT run) AS total_runs, round({_MEAN}, 3) AS avg_score, max(score) AS best_ever, count(DISTINCT variant) AS variants_tried,
      count(DISTINCT iteration) AS iterations_tried FROM eval_scores WHERE {_AC} GROUP BY 1 HAVING round({_MEAN}, 3) < 0.5 AND count(DISTINCT run) >= 3
    ORDER BY avg_score, input_id LIMIT 20
    """,
    S,
)
def _(t):
    return E.persistent_failures(t.eval_scores)


_SIDE = "round(CAST(sum(CAST(score AS DECIMAL(20,4))) FILTER ({c}) AS DOUBLE) / count(*) FILTER ({c}), 4)"


@query(
    "revalidation_drift",
    f"""
    WITH g AS (SELECT input_id, variant, {_SIDE.format(c="source <> 'revalidation'")} AS baseline_score, {_SIDE.format(c="source = 'revalidation'")} AS reval_score
      FROM eval_scores WHERE {_AC} GROUP BY 1, 2 HAVING count(*) FILTER (source = 'revalidation') > 0 AND count(*) FILTER (source <> 'revalidation') > 0)
    SELECT *, round(reval_score - baseline_score, 4) AS drift FROM g WHERE abs(round(reval_score - baseline_score, 4)) > 0.05 ORDER BY drift, input_id, variant LIMIT 20
    """,
    S,
)
def _(t):
    return E.revalidation_drift(t.eval_scores, 0.05)


@query(
    "question_history",
    f"SELECT iteration, variant, round({_MEAN}, 3) AS avg_score, count(*) AS runs FROM eval_scores WHERE {_AC} AND input_id = 7 GROUP BY 1, 2",
    S,
)
def _(t):
    return E.question_history(t.eval_scores, 7)


def _winner(where: str) -> str:
    m = "round(CAST(sum(CAST(score AS DECIMAL(20,4))) FILTER (metric = '{m}') AS DOUBLE) / count(*) FILTER (metric = '{m}'), 4) AS {m}"
    cols = ", ".join(m.format(m=x) for x in ("answer_correctness", "logical_consistency", "tool_selection_accuracy"))
    return f"""(SELECT variant, {cols}, round(stddev_samp(score) FILTER ({_AC}), 4) AS spread FROM eval_scores WHERE split = 'TEST' AND {where} GROUP BY 1
      ORDER BY answer_correctness DESC NULLS LAST, logical_consistency DESC NULLS LAST, tool_selection_accuracy DESC NULLS LAST, spread NULLS LAST, variant LIMIT 1)"""


@query("pick_variant", f"SELECT * FROM {_winner('true')}", S)
def _(t):
    return E.pick_variant(t.eval_scores)


@query(
    "failure_confidence",
    f"""
    WITH {_VERDICTS}, r AS (SELECT input_id, run, min(score) FILTER (metric = 'factual_verdict') AS v, min(score) FILTER ({_AC}) AS a FROM vs GROUP BY 1, 2),
    q AS (SELECT input_id, count(*) AS runs, count(*) FILTER (v = 0) AS failed_runs, count(*) FILTER (v = 1 AND a < 1) AS false_negative_runs FROM r WHERE v IS NOT NULL GROUP BY 1)
    SELECT *, CASE WHEN failed_runs = runs AND failed_runs > 0 THEN 'HIGH' WHEN failed_runs > 1 THEN 'MEDIUM' WHEN failed_runs = 1 THEN 'NOISE'
      WHEN false_negative_runs > 0 THEN 'FALSE_NEGATIVE' ELSE 'PASS' END AS confidence FROM q
    """,
    S,
)
def _(t):
    return E.failure_confidence(_verdict_scores(t))


_TOOLS = ["sql", "search", "chart"]
_LABELS = ["FORMATTING_ERROR", "CONTENT_ERROR", "INSTRUCTION_AMBIGUITY", "NONE"]


@query(
    "classify_failure",
    f"""
    WITH r AS (SELECT event_id, user_id % 4 AS failed_runs, CASE WHEN event_id % 3 > 0 THEN {sql_pick(_TOOLS, "event_id")} END AS expected_tool,
      {sql_pick(_TOOLS, "event_id + event_id // 50")} AS first_tool, event_type = 'error' AS has_error, {sql_pick(_LABELS, "user_id")} AS label, event_id % 5 AS prior FROM events)
    SELECT event_id, CASE WHEN failed_runs = 1 THEN 'INTERMITTENT' WHEN expected_tool IS NOT NULL AND expected_tool <> first_tool THEN 'ROUTING_ERROR'
      WHEN has_error THEN 'TOOL_ERROR' WHEN label <> 'NONE' THEN label WHEN prior >= 2 THEN 'MODEL_LIMIT' ELSE 'UNCLASSIFIED' END AS failure_class
    FROM r WHERE failed_runs > 0
    """,
)
def _(t):
    e, u = F.col("event_id"), F.col("user_id")
    rows = t.table("events").select(
        "event_id", (u % 4).alias("failed_runs"), F.when(e % 3 > 0, pick(_TOOLS, e)).alias("expected_tool"), pick(_TOOLS, e + F.floor(e / 50)).alias("first_tool"),
        (F.col("event_type") == "error").alias("has_error"), pick(_LABELS, u).alias("label"), (e % 5).alias("prior_iterations"),
    )
    return E.classify_failure(rows).select("event_id", "failure_class")


# ---- feedback ----

def feedback_events(t):
    """Feedback as JSON payloads: one per assistant turn."""
    n = F.length("text")
    body = F.struct(
        F.when(n % 5 != 0, F.col("conv_id")).alias("orig_request_id"),
        (n % 3 != 0).alias("positive"),
        F.when(n % 4 == 1, F.concat(F.lit("note "), (n % 9).cast("string"))).alias("feedback_message"),
        F.when(n % 6 == 2, F.array(F.lit("accuracy"), F.lit("format"))).alias("categories"),
    )
    return t.table("conversations").filter("role = 'assistant'").select(
        F.lit("FEEDBACK").alias("name"), F.to_json(body).alias("payload"), F.concat(F.lit("U"), (F.col("conv_id") % 7).cast("string")).alias("user_name"),
        _at(F.col("conv_id"), F.col("turn")).alias("ts"),
    )


def _at(conv, turn):
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((conv % 28).cast("int"), turn.cast("int"))


def requests(t):
    """First user turn of each conversation with the reply after it."""
    return t.table("conversations").filter("role <> 'system'").groupBy(F.col("conv_id").alias("record_id")).agg(
        F.min_by(F.when(F.col("role") == "user", F.col("text")), F.struct(F.when(F.col("role") == "user", 0).otherwise(1), "turn")).alias("input_query"),
        F.min_by(F.when(F.col("role") == "assistant", F.col("text")), F.struct(F.when(F.col("role") == "assistant", 0).otherwise(1), "turn")).alias("agent_response"),
    ).withColumn("user_name", F.when(F.col("record_id") % 9 == 0, "SYSTEM").otherwise(F.concat(F.lit("R"), (F.col("record_id") % 5).cast("string"))))


_FEEDBACK = """fb AS (SELECT CASE WHEN n % 5 <> 0 THEN conv_id END AS request_id, n % 3 <> 0 AS is_positive,
    CASE WHEN n % 4 = 1 THEN 'note ' || CAST(n % 9 AS VARCHAR) END AS feedback_message, CASE WHEN n % 6 = 2 THEN 'accuracy,format' END AS categories,
    'U' || CAST(conv_id % 7 AS VARCHAR) AS user_name, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(conv_id % 28 AS INT)) + to_hours(turn) AS ts
  FROM (SELECT *, length(text) AS n FROM conversations WHERE role = 'assistant')),
  rq AS (SELECT conv_id AS record_id, arg_min(text, turn) FILTER (role = 'user') AS input_query, arg_min(text, turn) FILTER (role = 'assistant') AS agent_response,
    CASE WHEN conv_id % 9 = 0 THEN 'SYSTEM' ELSE 'R' || CAST(conv_id % 5 AS VARCHAR) END AS request_user FROM conversations GROUP BY conv_id
    HAVING count(*) FILTER (role <> 'system') > 0),
  fr AS (SELECT request_id, is_positive, feedback_message, categories, user_name, ts, input_query, left(agent_response, 500) AS response_preview, request_user
    FROM fb JOIN rq ON request_id = record_id)"""


@query(
    "feedback_summary",
    f"""WITH {_FEEDBACK} SELECT is_positive, count(*) AS feedback_count, min(ts) AS earliest, max(ts) AS latest, count(DISTINCT user_name) AS distinct_users,
        count(request_id) AS request_level_count FROM fb GROUP BY 1""",
)
def _(t):
    return E.feedback_summary(E.parse_feedback(feedback_events(t)))


@query("feedback_requests", f"WITH {_FEEDBACK} SELECT * FROM fr")
def _(t):
    return E.feedback_requests(E.parse_feedback(feedback_events(t)), requests(t))


_CANDIDATES = f"""{_FEEDBACK}, win AS (SELECT ts AS s, ts + INTERVAL 3 HOUR AS e FROM fb WHERE user_name = 'U3' AND is_positive),
  cand AS (SELECT request_id, user_name, ts, is_positive, input_query, CAST(CASE WHEN NOT is_positive AND feedback_message IS NOT NULL THEN 3 ELSE 0 END
      + CASE WHEN NOT is_positive AND categories IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN is_positive AND feedback_message IS NOT NULL THEN 1 ELSE 0 END
      + CASE WHEN user_name IN ('U1', 'U2') THEN 2 ELSE 0 END + CASE WHEN coalesce(categories, '') = 'accuracy,format' THEN 2 ELSE 0 END AS BIGINT) AS priority
    FROM fr WHERE request_user <> 'SYSTEM' AND NOT regexp_matches(lower(input_query), 'last week|yesterday|this month|last month|recently|today')
      AND NOT regexp_matches(lower(input_query), 'what about|and for|same but|also show') AND NOT (NOT is_positive AND feedback_message IS NULL AND categories IS NULL)
      AND input_query NOT IN (SELECT text FROM conversations WHERE role = 'user' AND length(text) % 13 = 0)
      AND NOT EXISTS (SELECT 1 FROM win WHERE fr.ts BETWEEN win.s AND win.e))"""


def _candidates(t):
    fb = E.parse_feedback(feedback_events(t))
    windows = fb.filter("user_name = 'U3' and is_positive").select(F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("INTERVAL 3 HOUR")).alias("end_ts"))
    known = t.table("conversations").filter("role = 'user' and length(text) % 13 = 0").select(F.col("text").alias("input_query"))
    return E.feedback_candidates(E.feedback_requests(fb, requests(t)), known, windows, ["U1", "U2"], ["accuracy,format"])


@query("feedback_candidates", f"WITH {_CANDIDATES} SELECT * FROM cand")
def _(t):
    return _candidates(t)


@query(
    "promote_rows",
    f"""
    WITH {_CANDIDATES}, c AS (SELECT *, CAST(request_id AS VARCHAR) || '@' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS candidate_id FROM cand)
    SELECT row_number() OVER (ORDER BY priority DESC, md5(candidate_id)) + (SELECT max(test_id) FROM eval_questions) AS test_id, candidate_id, input_query,
      CAST(NULL AS VARCHAR) AS split FROM c
    """,
    Q,
)
def _(t):
    c = _candidates(t).withColumn("candidate_id", F.concat(F.col("request_id").cast("string"), F.lit("@"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return E.promote_rows(c, t.eval_questions)


@query(
    "score_bands",
    "SELECT metric, CASE WHEN score * 100 >= 80 THEN 'HIGH' WHEN score * 100 >= 30 THEN 'MEDIUM' ELSE 'FAILED' END AS band, count(*) AS score_count FROM eval_scores GROUP BY 1, 2",
    S,
)
def _(t):
    return E.score_bands(t.eval_scores)


@query(
    "truth_answerable",
    """
    WITH c AS (SELECT CASE WHEN error_message IS NOT NULL AND length(question) % 2 = 0 THEN 'FAIL' WHEN length(question) % 5 = 0 THEN 'REFUSED'
        WHEN length(question) % 4 > 0 THEN 'PASS' ELSE 'ZERO' END AS o FROM question_log)
    SELECT *, CASE WHEN errors > 0 THEN 'HARD_STOP' WHEN zero_rows + refused > 0 THEN 'SOFT_GATE' ELSE 'PASS' END AS gate FROM (
      SELECT count(*) AS total, count(*) FILTER (o = 'PASS') AS verified, count(*) FILTER (o = 'ZERO') AS zero_rows, count(*) FILTER (o = 'FAIL') AS errors,
        count(*) FILTER (o = 'REFUSED') AS refused FROM c)
    """,
    ("question_log",),
)
def _(t):
    n = F.length("question")
    checks = t.question_log.select(
        F.when(n % 2 == 0, F.col("error_message")).alias("error"), (n % 5 == 0).alias("is_refused"), (n % 4).alias("row_count")
    )
    return E.truth_answerable(checks)


@query(
    "revalidation_shift",
    f"""
    WITH b AS (SELECT * FROM {_winner("source = 'sweep'")}), a AS (SELECT * FROM {_winner("source = 'revalidation'")}),
    s AS (SELECT variant, source, round({_MEAN}, 4) AS m, round(stddev_samp(score), 4) AS sd FROM eval_scores WHERE split = 'TEST' AND {_AC} GROUP BY 1, 2)
    SELECT b.variant AS base_winner, a.variant AS new_winner, x.m AS base_mean, y.m AS new_mean, x.sd AS base_spread, y.sd AS new_spread,
      b.variant <> a.variant AS winner_changed, y.m < x.m * 0.9 AS metric_fell, y.sd > x.sd * 2 AS spread_doubled
    FROM b, a, s x, s y WHERE x.variant = b.variant AND x.source = 'sweep' AND y.variant = b.variant AND y.source = 'revalidation'
    """,
    S,
)
def _(t):
    s = t.eval_scores
    return E.revalidation_shift(s.filter("source = 'sweep'"), s.filter("source = 'revalidation'"))


_SETTINGS = ["FastPath", "DeepSearch", "Charts", "NewThing", "OldThing"]


@query(
    "setting_inventory",
    f"""
    WITH u AS (SELECT s AS setting, count(DISTINCT conv_id) AS spec_count FROM (SELECT conv_id, {sql_pick(_SETTINGS, "turn")} AS s FROM conversations) GROUP BY 1),
    k AS (SELECT * FROM (VALUES ('FastPath', 'ACTIVE', DATE '2024-01-20'), ('Charts', 'GA', DATE '2023-10-01'), ('OldThing', 'DEPRECATED', DATE '2024-01-20'), ('Unused', 'ACTIVE', DATE '2023-12-31')) v(setting, status, d))
    SELECT setting, coalesce(spec_count, 0) AS spec_count, CASE WHEN status IS NULL THEN 'UNVERIFIED' WHEN status = 'GA' THEN 'GENERAL' WHEN status = 'DEPRECATED' THEN 'DEPRECATED' ELSE 'UNCHANGED' END AS finding,
      coalesce(date_diff('day', d, DATE '2024-01-31') > 30, false) AS is_stale FROM u FULL JOIN k USING (setting)
    """,
)
def _(t):
    specs = t.table("conversations").groupBy(F.col("conv_id").alias("spec_id")).agg(
        F.to_json(F.map_from_arrays(F.array_sort(F.collect_set(pick(_SETTINGS, F.col("turn")))), F.transform(F.array_sort(F.collect_set(pick(_SETTINGS, F.col("turn")))), lambda x: F.lit("true")))).alias("settings")
    )
    known = t.spark.createDataFrame(
        [("FastPath", "ACTIVE", "2024-01-20"), ("Charts", "GA", "2023-10-01"), ("OldThing", "DEPRECATED", "2024-01-20"), ("Unused", "ACTIVE", "2023-12-31")],
        "setting string, status string, verified_on string",
    ).withColumn("verified_on", F.to_date("verified_on"))
    return E.setting_inventory(specs, known, "2024-01-31")


def agent_specs(t):
    """Specs as JSON, one per document, with faults that depend on its length."""
    n, k = F.col("n_chars"), F.col("doc_id")
    words = F.when(n % 3 == 0, "Answers questions about orders only. Do not use it for staff data. ").otherwise("Answers questions about orders and nothing else at all here. ")

    def tool(i):
        return F.struct(
            F.when(n % 7 == 0, "tool").otherwise(F.concat(F.lit("tool"), F.lit(str(i)))).alias("name"),
            F.when((n + i) % 3 == 0, "text_to_sql").when((n + i) % 3 == 1, "search").otherwise("generic").alias("type"),
            F.when(n % 2 == 0, F.repeat(words, 2)).otherwise(words).alias("description"),
            F.when(k % 4 == 0, "view_only").otherwise("db.core.view").alias("view"),
            F.when(k % 5 == 0, "svc").otherwise("db.core.svc").alias("service"),
            F.when(k % 6 != 0, "db.core.fn").alias("function"),
            F.when(k % 9 != 0, "wh").alias("warehouse"),
            (n % 8 != 0).alias("has_resource"),
        )

    spec = F.struct(
        F.when(k % 10 != 0, "model-a").alias("model"),
        F.when(n % 4 == 0, "short").otherwise("Route every question to the tool whose data it is about; you must invoke a tool.").alias("instructions"),
        F.when(k % 2 == 0, "router").otherwise("plain").alias("agent_type"),
        F.when(k % 3 != 0, "Agent").alias("display_name"),
        F.when(k % 7 != 0, 120).alias("budget_seconds"), F.lit(200000).alias("budget_tokens"), (k % 5 != 1).alias("agentic"),
        F.when(n % 11 == 0, F.slice(F.array(tool(1)), 1, 0))
        .otherwise(F.array(tool(1), tool(2), tool(3))).alias("tools"),
    )
    return t.table("documents").select(k.alias("spec_id"), F.to_json(spec).alias("spec"))


_LINT_TOOLS = "(n % 11 <> 0)"


@query(
    "lint_specs",
    f"""
    WITH d AS (SELECT doc_id AS k, n_chars AS n FROM documents),
    r AS (SELECT k, 1 AS rule, 'FAIL' AS severity FROM d WHERE k % 10 = 0
      UNION ALL SELECT k, 2, 'FAIL' FROM d WHERE n % 4 = 0
      UNION ALL SELECT k, 3, 'FAIL' FROM d WHERE {_LINT_TOOLS} AND k % 9 = 0
      UNION ALL SELECT k, 4, 'FAIL' FROM d WHERE n % 11 = 0
      UNION ALL SELECT k, 5, 'FAIL' FROM d WHERE {_LINT_TOOLS} AND n % 8 = 0
      UNION ALL SELECT k, 6, 'FAIL' FROM d WHERE {_LINT_TOOLS} AND n % 7 = 0
      UNION ALL SELECT k, 7, 'FAIL' FROM d WHERE {_LINT_TOOLS} AND k % 4 = 0
      UNION ALL SELECT k, 8, 'FAIL' FROM d WHERE {_LINT_TOOLS} AND k % 5 = 0
      UNION ALL SELECT k, 9, 'FAIL' FROM d WHERE {_LINT_TOOLS} AND k % 6 = 0
      UNION ALL SELECT k, 10, 'FAIL' FROM d WHERE {_LINT_TOOLS} AND n % 2 = 1
      UNION ALL SELECT k, 11, 'WARN' FROM d WHERE {_LINT_TOOLS} AND n % 3 <> 0
      UNION ALL SELECT k, 12, 'WARN' FROM d WHERE k % 7 = 0
      UNION ALL SELECT k, 13, 'WARN' FROM d WHERE k % 5 = 1
      UNION ALL SELECT k, 14, 'WARN' FROM d WHERE k % 3 = 0
      UNION ALL SELECT k, 16, 'WARN' FROM d WHERE k % 2 = 0 AND n % 4 = 0)
    SELECT k AS spec_id, CAST(rule AS BIGINT) AS rule, severity FROM r
    """,
)
def _(t):
    return E.lint_specs(agent_specs(t))
