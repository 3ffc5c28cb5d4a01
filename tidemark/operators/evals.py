"""Evaluation analytics: truth checks, splits, scores, comparisons, feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import merged_spans, money, null_safe_join, numbered, pick_bounded, rounded

CORRECTNESS = "answer_correctness"

# One-sided critical values of t at 0.10, by number of runs.
CRITICAL_T = {3: -1.886, 4: -1.638, 5: -1.533, 6: -1.476, 8: -1.415, 10: -1.383}

# Phrases that tie a question to a time or to an earlier turn.
RELATIVE_TIME = "last week|yesterday|this month|last month|recently|today"
FOLLOW_UP = "what about|and for|same but|also show"


def exact_mean(c: str) -> Column:
    return F.sum(money(F.col(c))).cast("double") / F.count(c)


def convert_eval(source: DataFrame) -> DataFrame:
    """Question and ground truth as JSON: the answer and the tool expected first, if any."""
    tool = F.struct(F.col("tool").alias("tool_name"), F.lit(1).alias("tool_sequence"))
    tools = F.when(F.coalesce("tool", F.lit("")) != "", F.array(tool)).otherwise(F.array().cast("array<struct<tool_name:string,tool_sequence:int>>"))
    truth = F.struct(
        F.coalesce("answer", F.lit("")).alias("ground_truth_output"), tools.alias("ground_truth_invocations")
    )
    return source.select("test_id", F.col("question").alias("input_query"), F.to_json(truth).alias("ground_truth"))


def validate_truth(questions: DataFrame) -> DataFrame:
    """Per split: null, missing, blank and valid ground truths, and whether all are valid."""
    out = F.get_json_object("ground_truth", "$.ground_truth_output")
    null = F.col("ground_truth").isNull()
    return questions.groupBy("split").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(null).alias("null_truth"),
        F.count_if(~null & out.isNull()).alias("missing_output"),
        F.count_if(F.trim(out) == "").alias("blank_output"),
        F.count_if(F.trim(out) != "").alias("valid"),
    ).withColumn("gate", F.when(F.col("valid") == F.col("total"), "PASS").otherwise("FAIL"))


def stratified_split(questions: DataFrame, share: float = 0.45, seed: int = 42) -> DataFrame:
    """Development and test split inside each category, in a seeded hash order."""
    keyed = questions.withColumn("_k", F.concat_ws(":", F.lit(str(seed)), F.col("test_id").cast("string")))
    sizes = questions.groupBy("test_category").agg(F.count(F.lit(1)).alias("_n"))
    ranked = null_safe_join(numbered(keyed, ["test_category"], [], "_k", "_p"), sizes, ["test_category"])
    return ranked.select(
        "test_id", "test_category", F.when(F.col("_p") <= rounded(F.col("_n") * share), "DEV").otherwise("TEST").alias("split")
    )


def validate_split(questions: DataFrame) -> DataFrame:
    """Checks of a split: ratio and coverage per category, and the overall balance."""
    dev, test = F.count_if(F.col("split") == "DEV"), F.count_if(F.col("split") == "TEST")
    g = questions.rollup("test_category").agg(
        F.count(F.lit(1)).alias("total"), dev.alias("dev_count"), test.alias("test_count"),
        rounded(F.try_divide(dev.cast("double"), F.count(F.lit(1))), 2).alias("dev_ratio"), F.grouping("test_category").alias("_all"),
    )
    ratio = F.try_divide(F.col("dev_count").cast("double"), F.col("total"))
    overall = F.col("_all") == 1
    return g.select(
        F.when(overall, "ALL").otherwise(F.col("test_category")).alias("test_category"),
        "total", "dev_count", "test_count", "dev_ratio",
        F.when(F.when(overall, ratio.between(0.40, 0.50)).otherwise(ratio.between(0.35, 0.55)), "PASS").otherwise("WARN").alias("balance"),
        F.when((F.col("dev_count") >= 3) & (F.col("test_count") >= 3), "PASS").otherwise("FAIL").alias("coverage"),
    )


def moves_needed(questions: DataFrame, low: float = 0.35, high: float = 0.55) -> DataFrame:
    """Fewest moves that bring each category into bounds: positive to DEV, negative to TEST."""
    c = questions.groupBy("test_category").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("split") == "DEV").alias("before_dev"))
    n, d = F.col("total"), F.col("before_dev")
    moves = F.when(d < n * low, F.ceil(n * low) - d).when(d > n * high, F.floor(n * high) - d).otherwise(0)
    return c.withColumn("moves", moves.cast("bigint")).withColumn("after_dev", F.col("before_dev") + F.col("moves"))


def rebalance(questions: DataFrame) -> DataFrame:
    """Questions to move, in hash order, with the split each goes to."""
    need = moves_needed(questions).filter("moves <> 0").select(
        "test_category", F.abs("moves").alias("_m"), F.when(F.col("moves") > 0, "TEST").otherwise("DEV").alias("split"),
        F.when(F.col("moves") > 0, "DEV").otherwise("TEST").alias("new_split"),
    )
    pool = numbered(questions.select("test_id", "test_category", "split"), ["test_category", "split"], [], "test_id", "_p")
    return pool.join(need, ["test_category", "split"]).filter(F.col("_p") <= F.col("_m")).select("test_id", "test_category", "split", "new_split")


def merge_small(questions: DataFrame, min_size: int = 6, candidates: int = 5) -> DataFrame:
    """Nearest categories, by edit distance and then size, for each category that is too small.

    Categories are few; the small ones are compared with all others.
    """
    c = questions.groupBy("test_category").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("split") == "DEV").alias("dev"))
    small = c.filter(F.col("total") < min_size).select(
        F.col("test_category").alias("small_category"), F.col("total").alias("_st"), F.col("dev").alias("_sd")
    )
    pairs = c.join(small, F.col("test_category") != F.col("small_category")).withColumn("edit_distance", F.levenshtein("test_category", "small_category").cast("bigint"))
    best = pick_bounded(pairs, ["small_category"], [F.col("edit_distance"), F.desc("total"), F.col("test_category")], candidates)
    merged, dev = F.col("total") + F.col("_st"), F.col("dev") + F.col("_sd")
    return best.select(
        "small_category", F.col("test_category").alias("target_category"), "edit_distance", "total", merged.alias("total_after"),
        dev.alias("dev_after"), rounded(dev / merged, 4).alias("dev_ratio_after"), ((dev >= 3) & (merged - dev >= 3)).alias("covered_after"),
    )


def run_means(scores: DataFrame) -> DataFrame:
    """Mean per run and metric."""
    return scores.groupBy("variant", "split", "metric", "run").agg(
        rounded(exact_mean("score"), 6).alias("mean_score"), F.count("score").alias("scored"), F.count_if("is_error").alias("errors")
    )


def score_summary(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation in percent per variant, split and metric."""
    return scores.groupBy("variant", "split", "metric").agg(
        rounded(exact_mean("score") * 100, 1).alias("mean_pct"), rounded(F.stddev_samp("score") * 100, 1).alias("stddev_pct"), F.count("score").alias("n")
    )


def paired_t(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Paired t per metric over runs, with the decision; inputs hold (metric, run, mean_score).

    Equal differences give t = 0 for a mean of zero, else plus or minus infinity.
    """
    d = current.select("metric", "run", F.col("mean_score").alias("_a")).join(previous.select("metric", "run", F.col("mean_score").alias("_b")), ["metric", "run"])
    s = d.withColumn("_d", F.col("_a") - F.col("_b")).groupBy("metric").agg(
        F.count("_d").alias("runs"), F.avg("_d").alias("_m"), F.stddev_samp("_d").alias("_s")
    )
    flat = F.coalesce(F.col("_s"), F.lit(0.0)) < 1e-12
    t = (
        F.when(flat & (F.abs("_m") < 1e-12), F.lit(0.0)).when(flat & (F.col("_m") > 0), F.lit(float("inf")))
        .when(flat, F.lit(float("-inf"))).otherwise(F.col("_m") / (F.col("_s") / F.sqrt("runs")))
    )
    limit = None
    for n, v in CRITICAL_T.items():
        hit = F.col("runs") == n
        limit = F.when(hit, F.lit(v)) if limit is None else limit.when(hit, F.lit(v))
    return s.withColumn("critical", limit).select(
        "metric", "runs", rounded("_m", 4).alias("mean_diff"), rounded(t, 3).alias("t_value"), "critical",
        F.when(F.col("critical").isNull(), "UNKNOWN").when(t >= F.col("critical"), "ACCEPT").otherwise("REJECT").alias("decision"),
    )


def accepted(tests: DataFrame) -> DataFrame:
    """Whether no metric was rejected; null where none was but a number of runs without a critical value leaves it open."""
    verdict = F.when(F.col("decision") == "REJECT", False).when(F.col("decision") == "ACCEPT", True)
    open_ = F.bool_or(F.col("decision") == "UNKNOWN") & F.bool_and(F.coalesce(verdict, F.lit(True)))
    return tests.agg(F.when(~open_, F.bool_and(verdict)).alias("is_accepted"), F.count_if(F.col("decision") == "REJECT").alias("rejected_metrics"))


def verdict_matrix(scores: DataFrame) -> DataFrame:
    """Built-in score against the binary verdict; one row per question and run with both."""
    both = scores.filter(F.col("metric").isin(CORRECTNESS, "factual_verdict")).groupBy("input_id", "run").agg(
        F.max(F.when(F.col("metric") == CORRECTNESS, F.col("score"))).alias("answer_correctness"),
        F.max(F.when(F.col("metric") == "factual_verdict", F.col("score"))).alias("factual_verdict"),
    ).dropna()
    a, v = F.col("answer_correctness"), F.col("factual_verdict")
    return both.withColumn(
        "verdict_category",
        F.when((a < 1.0) & (v == 1.0), "FALSE_NEGATIVE").when((a >= 0.67) & (v == 0.0), "LENIENT_BUILTIN")
        .when((a < 1.0) & (v == 0.0), "BOTH_AGREE_WRONG").when((a == 1.0) & (v == 1.0), "BOTH_AGREE_CORRECT").otherwise("OTHER"),
    )


def append_manifest(scores: DataFrame, source: str, iteration: str | None, agent: str) -> DataFrame:
    """Scores in the long form of the history table."""
    return scores.select(
        "input_id", F.col("metric").alias("metric_name"), "score", F.lit(source).alias("source"),
        F.concat_ws("_", "variant", F.lower("split"), F.concat(F.lit("r"), F.col("run").cast("string"))).alias("run_label"),
        "variant", (F.lit(iteration) if iteration is not None else F.col("iteration").cast("string")).alias("iteration"), F.lit(agent).alias("agent"),
    )


def transfer_opportunities(scores: DataFrame, passing: float = 0.8, failing: float = 0.5, top: int = 20) -> DataFrame:
    """Questions that pass under one variant and fail under another, widest gap first.

    Only the best and worst `top` scores of a question and variant can be part of
    the answer, so the two sides are cut to these before they meet.
    """
    s = scores.filter(F.col("metric") == CORRECTNESS)
    key = ["input_id", "variant"]
    best = pick_bounded(s.filter(F.col("score") >= passing), key, [F.desc("score"), F.col("score_id")], top)
    worst = pick_bounded(s.filter(F.col("score") < failing), key, [F.col("score"), F.col("score_id")], top)
    b = best.select("input_id", F.col("variant").alias("passing_variant"), F.col("score").alias("passing_score"), F.col("score_id").alias("passing_id"))
    w = worst.select("input_id", F.col("variant").alias("failing_variant"), F.col("score").alias("failing_score"), F.col("score_id").alias("failing_id"))
    return (
        b.join(w, "input_id")
        .filter(F.col("passing_variant") != F.col("failing_variant"))
        .withColumn("gap", rounded(F.col("passing_score") - F.col("failing_score"), 4))
        .orderBy(F.desc("gap"), F.desc("passing_score"), "passing_id", "failing_id")
        .limit(top)
    )


def divergent(scores: DataFrame, variants: Sequence[str], min_range: float = 0.3, top: int = 20) -> DataFrame:
    """Questions whose scores differ most between variants, one column per variant."""
    s = scores.filter(F.col("metric") == CORRECTNESS)
    return (
        s.groupBy("input_id")
        .agg(
            rounded(F.max("score") - F.min("score"), 4).alias("score_range"),
            *[F.max(F.when(F.col("variant") == v, F.col("score"))).alias(v) for v in variants],
        )
        .filter(F.col("score_range") > min_range)
        .orderBy(F.desc("score_range"), "input_id")
        .limit(top)
    )


def persistent_failures(scores: DataFrame, below: float = 0.5, min_runs: int = 3, top: int = 20) -> DataFrame:
    """Questions that score badly over several runs."""
    return (
        scores.filter(F.col("metric") == CORRECTNESS)
        .groupBy("input_id")
        .agg(
            F.count_distinct("run").alias("total_runs"), rounded(exact_mean("score"), 3).alias("avg_score"), F.max("score").alias("best_ever"),
            F.count_distinct("variant").alias("variants_tried"), F.count_distinct("iteration").alias("iterations_tried"),
        )
        .filter((F.col("avg_score") < below) & (F.col("total_runs") >= min_runs))
        .orderBy("avg_score", "input_id")
        .limit(top)
    )


def revalidation_drift(scores: DataFrame, min_drift: float = 0.2, top: int = 20) -> DataFrame:
    """Change of the mean between first sweep and re-check per question and variant."""
    is_re = F.col("source") == "revalidation"
    both = scores.filter(F.col("metric") == CORRECTNESS).groupBy("input_id", "variant").agg(
        F.count_if(is_re).alias("_r"), F.count_if(~is_re).alias("_b"),
        rounded(F.try_divide(F.sum(F.when(~is_re, money(F.col("score")))).cast("double"), F.count_if(~is_re)), 4).alias("baseline_score"),
        rounded(F.try_divide(F.sum(F.when(is_re, money(F.col("score")))).cast("double"), F.count_if(is_re)), 4).alias("reval_score"),
    ).filter((F.col("_r") > 0) & (F.col("_b") > 0))
    return (
        both.select("input_id", "variant", "baseline_score", "reval_score", rounded(F.col("reval_score") - F.col("baseline_score"), 4).alias("drift"))
        .filter(F.abs("drift") > min_drift)
        .orderBy("drift", "input_id", "variant")
        .limit(top)
    )


def question_history(scores: DataFrame, input_id: int) -> DataFrame:
    """Mean and runs of one question by iteration and variant."""
    return scores.filter((F.col("metric") == CORRECTNESS) & (F.col("input_id") == input_id)).groupBy("iteration", "variant").agg(
        rounded(exact_mean("score"), 3).alias("avg_score"), F.count(F.lit(1)).alias("runs")
    )


def pick_variant(scores: DataFrame) -> DataFrame:
    """Variant with the best test scores: correctness, consistency, tool choice, then spread."""
    metrics = [CORRECTNESS, "logical_consistency", "tool_selection_accuracy"]
    mean = lambda m: F.try_divide(
        F.sum(F.when(F.col("metric") == m, money(F.col("score")))).cast("double"), F.count_if(F.col("metric") == m)
    )
    return (
        scores.filter(F.col("split") == "TEST")
        .groupBy("variant")
        .agg(
            *[rounded(mean(m), 4).alias(m) for m in metrics],
            rounded(F.stddev_samp(F.when(F.col("metric") == CORRECTNESS, F.col("score"))), 4).alias("spread"),
        )
        .orderBy(*[F.desc_nulls_last(m) for m in metrics], F.asc_nulls_last("spread"), "variant")
        .limit(1)
    )


def failure_confidence(scores: DataFrame) -> DataFrame:
    """Per question: failed in all runs, in some, in one only, or wrongly counted as failed.

    A run counts as failed when its verdict, the lowest of the run, is zero.
    """
    runs = scores.groupBy("input_id", "run").agg(
        F.min(F.when(F.col("metric") == "factual_verdict", F.col("score"))).alias("_v"),
        F.min(F.when(F.col("metric") == CORRECTNESS, F.col("score"))).alias("_a"),
    ).filter(F.col("_v").isNotNull())
    q = runs.groupBy("input_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("_v") == 0).alias("failed_runs"),
        F.count_if((F.col("_v") == 1) & (F.col("_a") < 1)).alias("false_negative_runs"),
    )
    f = F.col("failed_runs")
    return q.withColumn(
        "confidence",
        F.when((f == F.col("runs")) & (f > 0), "HIGH").when(f > 1, "MEDIUM").when(f == 1, "NOISE")
        .when(F.col("false_negative_runs") > 0, "FALSE_NEGATIVE").otherwise("PASS"),
    )


def classify_failure(rows: DataFrame, persistent_after: int = 2) -> DataFrame:
    """First cause that applies to each failed question.

    Needs failed_runs, expected_tool, first_tool, has_error, label (a judged cause
    or null) and prior_iterations with the same failure.
    """
    cause = (
        F.when(F.col("failed_runs") == 1, "INTERMITTENT")
        .when(F.col("expected_tool").isNotNull() & ~F.col("expected_tool").eqNullSafe(F.col("first_tool")), "ROUTING_ERROR")
        .when(F.col("has_error"), "TOOL_ERROR")
        .when(F.col("label").isin("FORMATTING_ERROR", "CONTENT_ERROR", "INSTRUCTION_AMBIGUITY"), F.col("label"))
        .when(F.col("prior_iterations") >= persistent_after, "MODEL_LIMIT")
        .otherwise("UNCLASSIFIED")
    )
    return rows.filter("failed_runs > 0").withColumn("failure_class", cause)


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Feedback by polarity: count, first, last, users, and how much of it names a request."""
    return feedback.groupBy("is_positive").agg(
        F.count(F.lit(1)).alias("feedback_count"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"),
        F.count_distinct("user_name").alias("distinct_users"), F.count("request_id").alias("request_level_count"),
    )


def parse_feedback(events: DataFrame) -> DataFrame:
    """Feedback fields out of JSON payloads."""
    j = F.from_json("payload", "orig_request_id bigint, positive boolean, feedback_message string, categories array<string>")
    return events.filter("name = 'FEEDBACK'").withColumn("_j", j).select(
        F.col("_j.orig_request_id").alias("request_id"), F.col("_j.positive").alias("is_positive"),
        F.col("_j.feedback_message").alias("feedback_message"), F.array_join("_j.categories", ",").alias("categories"), "user_name", "ts",
    )


def feedback_requests(feedback: DataFrame, requests: DataFrame, preview: int = 500) -> DataFrame:
    """Feedback joined to the request it is about."""
    r = requests.select(F.col("record_id").alias("_id"), "input_query", F.col("agent_response").alias("_r"), F.col("user_name").alias("request_user"))
    return feedback.filter(F.col("request_id").isNotNull()).join(r, F.col("request_id") == F.col("_id")).select(
        "request_id", "is_positive", "feedback_message", "categories", "user_name", "ts", "input_query", F.left("_r", F.lit(preview)).alias("response_preview"), "request_user"
    )


def feedback_candidates(
    joined: DataFrame, known: DataFrame, windows: DataFrame, experts: Sequence[str] = (), rare_categories: Sequence[str] = (), test_users: Sequence[str] = ("SYSTEM",)
) -> DataFrame:
    """Feedback worth promoting to an evaluation row, with its priority.

    `windows` holds the time spans of evaluation runs. Overlapping ones are merged and cut into hours, so that feedback
    meets one span for each gap of its hour, however many windows there are.
    """
    q = F.lower("input_query")
    message, cats = F.col("feedback_message").isNotNull(), F.coalesce("categories", F.lit("")) != ""
    kept = joined.filter(
        ~F.col("request_user").isin(*test_users)
        & ~q.rlike(RELATIVE_TIME)
        & ~q.rlike(FOLLOW_UP)
        & ~(~F.col("is_positive") & ~message & ~cats)
    ).join(known.select("input_query").distinct(), "input_query", "left_anti")
    spans = merged_spans(windows, "start_ts", "end_ts")
    kept = kept.join(spans, (F.date_trunc("HOUR", "ts") == F.col("slot")) & F.col("ts").between(F.col("start_ts"), F.col("end_ts")), "left_anti")
    negative = ~F.col("is_positive")
    points = (
        F.when(negative & message, 3).otherwise(0) + F.when(negative & cats, 2).otherwise(0) + F.when(~negative & message, 1).otherwise(0)
        + F.when(F.col("user_name").isin(*experts), 2).otherwise(0) + F.when(F.col("categories").isin(*rare_categories), 2).otherwise(0)
    )
    return kept.select("request_id", "user_name", "ts", "is_positive", "input_query", points.cast("bigint").alias("priority"))


def promote_rows(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """Candidates as new evaluation rows, numbered after the highest id, without a split."""
    top = F.coalesce(questions.select(F.max("test_id")).scalar(), F.lit(0))
    ranked = numbered(candidates.withColumn("_neg", -F.col("priority")), [], ["_neg"], "candidate_id", "_p")
    return ranked.select((F.col("_p") + top).alias("test_id"), "candidate_id", "input_query", F.lit(None).cast("string").alias("split"))


def score_bands(scores: DataFrame) -> DataFrame:
    """Scores in percent as high, medium and failed, per metric."""
    pct = F.col("score") * 100
    return scores.groupBy("metric", F.when(pct >= 80, "HIGH").when(pct >= 30, "MEDIUM").otherwise("FAILED").alias("band")).agg(F.count(F.lit(1)).alias("score_count"))


def truth_answerable(checks: DataFrame) -> DataFrame:
    """Outcome of checking each ground truth, counted, with the gate."""
    outcome = (
        F.when(F.col("error").isNotNull(), "FAIL").when(F.col("is_refused"), "WARN").when(F.col("row_count") >= 1, "PASS").otherwise("WARN")
    )
    return checks.withColumn("_o", outcome).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("_o") == "PASS").alias("verified"),
        F.count_if((F.col("_o") == "WARN") & ~F.col("is_refused")).alias("zero_rows"), F.count_if(F.col("_o") == "FAIL").alias("errors"),
        F.count_if((F.col("_o") == "WARN") & F.col("is_refused")).alias("refused"),
    ).withColumn(
        "gate", F.when(F.col("errors") > 0, "HARD_STOP").when(F.col("zero_rows") + F.col("refused") > 0, "SOFT_GATE").otherwise("PASS")
    )


def revalidation_shift(base: DataFrame, again: DataFrame, drop: float = 0.10) -> DataFrame:
    """Whether the winner changed, its correctness fell, or its spread doubled since the first sweep.

    An old winner that the check lacks has no new figures; the winner has then changed.
    """
    b = pick_variant(base).select(F.col("variant").alias("base_winner"))
    a = pick_variant(again).select(F.col("variant").alias("new_winner"))
    side = lambda df, p: df.filter((F.col("split") == "TEST") & (F.col("metric") == CORRECTNESS)).groupBy("variant").agg(
        rounded(exact_mean("score"), 4).alias(f"{p}_mean"), rounded(F.stddev_samp("score"), 4).alias(f"{p}_spread")
    )
    both = side(base, "base").join(side(again, "new"), "variant", "left")
    return both.filter(F.col("variant") == b.select("base_winner").scalar()).select(
        F.col("variant").alias("base_winner"),
        a.select("new_winner").scalar().alias("new_winner"),
        "base_mean", "new_mean", "base_spread", "new_spread",
    ).withColumns(
        {
            "winner_changed": ~F.col("base_winner").eqNullSafe(F.col("new_winner")),
            "metric_fell": F.col("new_mean") < F.col("base_mean") * (1 - drop),
            "spread_doubled": F.col("new_spread") > F.col("base_spread") * 2,
        }
    )


def setting_inventory(specs: DataFrame, known: DataFrame, as_of: str, max_age_days: int = 30) -> DataFrame:
    """Settings used in specs against a known list: new, general, deprecated or unchanged.

    `specs` holds (spec_id, settings as JSON), `known` (setting, status, verified_on).
    """
    used = (
        specs.select(F.explode(F.map_keys(F.from_json("settings", "map<string,string>"))).alias("setting"), "spec_id")
        .groupBy("setting")
        .agg(F.count_distinct("spec_id").alias("spec_count"))
    )
    age = F.datediff(F.lit(as_of[:10]).cast("date"), F.col("verified_on"))
    return used.join(known, "setting", "full_outer").select(
        "setting",
        F.coalesce("spec_count", F.lit(0)).alias("spec_count"),
        F.when(F.col("status").isNull(), "UNVERIFIED").when(F.col("status") == "GA", "GENERAL").when(F.col("status") == "DEPRECATED", "DEPRECATED")
        .otherwise("UNCHANGED").alias("finding"),
        F.coalesce(age > max_age_days, F.lit(False)).alias("is_stale"),
    )


# Wording that sets the limits of a tool.
BOUNDARY = "not use|do not|only for|avoid"
THREE_PART = r"^\w+\.\w+\.\w+$"


def lint_specs(specs: DataFrame, max_tools: int = 10) -> DataFrame:
    """Findings on agent specs given as JSON, one row per spec and broken rule.

    The spec: models.orchestration, instructions.orchestration, agent_type, display_name,
    tools[] (name, type, description, view, service, function, warehouse, has_resource), budget, flags.
    """
    schema = (
        "model string, instructions string, agent_type string, display_name string, budget_seconds bigint, budget_tokens bigint, "
        "agentic boolean, tools array<struct<name:string,type:string,description:string,view:string,service:string,function:string,"
        "warehouse:string,has_resource:boolean>>"
    )
    s = specs.withColumn("_s", F.from_json("spec", schema)).select("spec_id", "_s.*")
    none = F.array().cast("array<struct<name:string,type:string,description:string,view:string,service:string,function:string,warehouse:string,has_resource:boolean>>")
    tools = F.coalesce("tools", none)
    names = F.transform(tools, lambda t: t["name"])
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    some = lambda f: F.exists(tools, lambda t: F.coalesce(f(t), F.lit(False)))
    sql = lambda t: t["type"] == "text_to_sql"
    rules = [
        (1, "FAIL", blank(F.col("model"))),
        (2, "FAIL", F.length(F.coalesce("instructions", F.lit(""))) <= 50),
        (3, "FAIL", some(lambda t: sql(t) & blank(t["warehouse"]))),
        (4, "FAIL", F.size(tools) == 0),
        (5, "FAIL", some(lambda t: ~F.coalesce(t["has_resource"], F.lit(False)))),
        (6, "FAIL", F.size(F.array_distinct(names)) < F.size(names)),
        (7, "FAIL", some(lambda t: sql(t) & ~F.coalesce(t["view"], F.lit("")).rlike(THREE_PART))),
        (8, "FAIL", some(lambda t: (t["type"] == "search") & ~F.coalesce(t["service"], F.lit("")).rlike(THREE_PART))),
        (9, "FAIL", some(lambda t: (t["type"] == "generic") & blank(t["function"]))),
        (10, "FAIL", some(lambda t: F.length(F.coalesce(t["description"], F.lit(""))) <= 100)),
        (11, "WARN", some(lambda t: ~F.lower(F.coalesce(t["description"], F.lit(""))).rlike(BOUNDARY))),
        (12, "WARN", F.col("budget_seconds").isNull() | F.col("budget_tokens").isNull()),
        (13, "WARN", ~F.coalesce("agentic", F.lit(False))),
        (14, "WARN", blank(F.col("display_name"))),
        (15, "WARN", F.size(tools) > max_tools),
        (
            16, "WARN",
            (F.coalesce("agent_type", F.lit("")) == "router")
            & ~F.lower(F.coalesce("instructions", F.lit(""))).rlike("do not attempt to answer|must invoke|never answer yourself"),
        ),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).cast("bigint").alias("rule"), F.lit(sev).alias("severity"))) for n, sev, c in rules]))
    return s.select("spec_id", F.explode(found).alias("_f")).select("spec_id", "_f.rule", "_f.severity")


