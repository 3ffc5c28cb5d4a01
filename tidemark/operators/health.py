"""Pipeline health: failures, runbooks, guardrails, breakers, trends, change impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import money, percent, pick_bounded, rounded
from tidemark.functions.literals import fitting_pairs, required_literals

# Operations that are never run on their own.
BLOCKED = (
    "DROP DATABASE|DROP SCHEMA|DROP TABLE|DROP VIEW|DROP DYNAMIC TABLE|DROP TASK|TRUNCATE|DELETE FROM|GRANT |REVOKE |"
    "CREATE USER|ALTER USER|CREATE ROLE|DROP ROLE"
)

# Priority by lifecycle of a change (rows) and severity, with the window to act in.
PRIORITIES = (
    ("Disabled by Default", "CRITICAL", "HIGH"),
    ("Disabled by Default", "WARNING", "MEDIUM"),
    ("Enabled by Default", "CRITICAL", "URGENT"),
    ("Enabled by Default", "WARNING", "HIGH"),
    ("Generally Enabled", "CRITICAL", "URGENT"),
    ("Generally Enabled", "WARNING", "URGENT"),
)
WINDOWS = {"URGENT": "within 1 week", "HIGH": "within 2-4 weeks", "MEDIUM": "within 1-2 months"}


def after(ts: str, as_of: str, hours: float) -> Column:
    return F.col(ts) > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL '{int(hours * 60)}' MINUTE")


def detect_failures(history: DataFrame, known: DataFrame, as_of: str, hours: int = 1, cap: int | None = None) -> DataFrame:
    """Failed runs of the look-back that are not recorded yet, all of them or the newest `cap` per type.

    The known side is matched on its own time, type and name. The usual cap is 100.
    """
    fresh = history.filter(after("ts", as_of, hours) & F.col("state").isin("FAILED", "UPSTREAM_FAILED")).join(
        known.select("object_name", "object_type", F.col("detected_at").alias("ts")), ["object_name", "object_type", "ts"], "left_anti"
    )
    if cap is not None:
        fresh = pick_bounded(fresh, ["object_type"], [F.desc("ts"), F.col("object_name")], cap)
    return fresh.select("object_name", "object_type", "ts", "state", "message")


def match_runbook(failures: DataFrame, runbook: DataFrame) -> DataFrame:
    """Surest runbook entry for each failure.

    Failures share few texts, so each distinct text is tried once, with the
    patterns whose literals it holds, and the result joined back.
    """
    texts = failures.select("error_message", "object_type").distinct()
    pairs = fitting_pairs(failures, "error_message", runbook, "error_pattern", required_literals(F.col("error_pattern")), F.expr("error_message rlike error_pattern"))
    of_type = (F.col("book_type") == "ALL") | (F.col("book_type") == F.col("object_type"))
    best = (
        texts.join(pairs, "error_message").join(runbook.withColumnRenamed("object_type", "book_type"), "error_pattern").filter(of_type)
        .groupBy("error_message", "object_type")
        .agg(
            F.min_by(
                F.struct("error_pattern", "error_category", "fix_template", "confidence"),
                F.struct(-F.col("confidence"), F.col("error_pattern")),
            ).alias("_b")
        )
    )
    return failures.join(best, ["error_message", "object_type"], "left").select(
        "failure_id",
        "object_name",
        "object_type",
        F.col("_b.error_pattern").alias("error_pattern"),
        F.col("_b.error_category").alias("error_category"),
        F.replace(F.col("_b.fix_template"), F.lit("{OBJECT}"), F.col("object_name")).alias("fix"),
        F.col("_b.confidence").alias("confidence"),
    )


def runbook_usage(runbook: DataFrame, matched: DataFrame) -> DataFrame:
    """Runbook with the number of failures each entry now answers."""
    used = matched.filter(F.col("error_pattern").isNotNull()).groupBy("error_pattern").agg(F.count(F.lit(1)).alias("_n"))
    return runbook.join(used, "error_pattern", "left").select(
        "error_pattern", "object_type", (F.col("times_used") + F.coalesce("_n", F.lit(0))).alias("times_used")
    )


def guardrail(fixes: DataFrame, min_confidence: float = 0.8, min_runbook: float = 0.8) -> DataFrame:
    """Whether a proposed fix may run: PASS, REVIEW:reason or BLOCK:reason.

    Needs fix, confidence and runbook_confidence (null without a match).
    """
    sql = F.upper("fix")
    changes = (
        (sql.contains("ALTER ") & ~sql.contains("ALTER TASK") & ~sql.contains("ALTER DYNAMIC TABLE"))
        | (sql.contains("ALTER TASK") & sql.contains("MODIFY AS"))
        | sql.contains("CREATE OR REPLACE")
    )
    safe = (
        (sql.contains("ALTER TASK") & sql.rlike("RESUME|SET WAREHOUSE|SUSPEND"))
        | (sql.contains("ALTER DYNAMIC TABLE") & sql.contains("REFRESH"))
        | sql.contains("EXECUTE TASK")
        | sql.contains("TASK_DEPENDENTS_ENABLE")
        | sql.startswith("SELECT")
    )
    sure = F.coalesce(F.col("confidence") >= min_confidence, F.lit(False))
    known = F.coalesce(F.col("runbook_confidence") >= min_runbook, F.lit(False))
    result = (
        F.when(sql.rlike(BLOCKED), "BLOCK:BLOCKED_OPERATION")
        .when(sql.contains("'NEEDS_"), "REVIEW:NEEDS_DIAGNOSIS")
        .when(changes & known & sure, "PASS")
        .when(changes, "REVIEW:BLOCKED_OPERATION")
        .when(safe & sure, "PASS")
        .when(~sure, "REVIEW:LOW_CONFIDENCE")
        .otherwise("REVIEW:UNKNOWN_OPERATION")
    )
    return fixes.withColumn("guardrail", F.coalesce(result, F.lit("REVIEW:LOW_CONFIDENCE")))


def circuit_breaker(failures: DataFrame, as_of: str, threshold: int = 10, loops: int = 3, attempts: int = 3) -> DataFrame:
    """Whether escalations of one hour or fix loops of two hours call for a stop."""
    escalated = after("detected_at", as_of, 1) & (F.col("status") == "ESCALATED")
    looping = (F.col("fix_attempts") >= attempts) & (F.col("status") != "RESOLVED")
    return failures.filter(after("detected_at", as_of, 2)).agg(
        F.count_if(escalated).alias("recent_escalations"), F.count_if(looping).alias("recent_fix_loops")
    ).withColumn(
        "state",
        F.when((F.col("recent_escalations") > threshold) | (F.col("recent_fix_loops") > loops), "CIRCUIT_BREAKER_TRIPPED").otherwise("OK"),
    )


def cost_anomaly(audit: DataFrame, limit: int = 50) -> DataFrame:
    """Hours with more model calls than allowed; runbook answers do not count."""
    return (
        audit.filter(F.col("action_type").isin("DIAGNOSE", "DIAGNOSE_DT") & (F.col("model_used") != "RUNBOOK"))
        .groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour_window"))
        .agg(F.count(F.lit(1)).alias("model_calls"), F.count_distinct("failure_id").alias("unique_failures"))
        .filter(F.col("model_calls") > limit)
    )


def health_kpis(failures: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Failures, repairs, escalations and success rate of the look-back, per type and in total."""
    status = F.col("status")
    return (
        failures.filter(after("detected_at", as_of, days * 24))
        .rollup("object_type")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(status == "RESOLVED").alias("auto_resolved"),
            F.count_if(status == "ESCALATED").alias("escalated"),
            F.count_if(status == "PENDING_REVIEW").alias("pending"),
            percent(F.count_if(status == "RESOLVED"), F.count(F.lit(1))).alias("success_rate_pct"),
        )
        .withColumn("object_type", F.coalesce("object_type", F.lit("ALL")))
    )


def failure_trend(failures: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Failures and success rate per day."""
    status = F.col("status")
    return (
        failures.filter(after("detected_at", as_of, days * 24))
        .groupBy(F.to_date("detected_at").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("total_failures"),
            F.count_if(status == "RESOLVED").alias("auto_resolved"),
            F.count_if(status == "ESCALATED").alias("escalated"),
            percent(F.count_if(status == "RESOLVED"), F.count(F.lit(1))).alias("success_rate_pct"),
        )
    )


def audit_mix(audit: DataFrame) -> DataFrame:
    """Calls and mean confidence per model and guardrail result."""
    return audit.groupBy("model_used", "guardrail_result").agg(
        F.count(F.lit(1)).alias("calls"),
        rounded(F.sum(money(F.col("confidence"))).cast("double") / F.count("confidence"), 4).alias("avg_confidence"),
    )


def latest_escalations(failures: DataFrame, top: int = 20) -> DataFrame:
    """Newest escalated failures."""
    return (
        failures.filter("status = 'ESCALATED'")
        .orderBy(F.desc("detected_at"), "failure_id")
        .limit(top)
        .select("object_name", "object_type", "error_message", "fix_attempts", "detected_at")
    )


def expire_reviews(reviews: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Reviews after their deadline: pending ones become escalated."""
    late = (F.col("review_status") == "PENDING") & ~after("created_at", as_of, hours)
    return reviews.withColumn("review_status", F.when(late, "ESCALATED").otherwise(F.col("review_status")))


def learn_patterns(reviews: DataFrame, runbook: DataFrame, min_fixes: int = 2) -> DataFrame:
    """Manual fixes of like errors that no runbook entry covers yet."""
    pattern = F.regexp_replace(F.regexp_replace("error_message", r"'[^']*'", "'.*'"), r"\d+", r"\\d+")
    found = (
        reviews.filter((F.col("review_status") == "APPROVED") & F.col("error_message").isNotNull())
        .groupBy(pattern.alias("candidate_pattern"), "object_type")
        .agg(F.count(F.lit(1)).alias("fixes"), F.min("error_message").alias("sample_message"))
        .filter(F.col("fixes") >= min_fixes)
    )
    covered = fitting_pairs(found, "sample_message", runbook, "error_pattern", required_literals(F.col("error_pattern")), F.expr("sample_message rlike error_pattern"))
    return found.join(covered.select("sample_message").distinct(), "sample_message", "left_anti").select(found.columns)


def change_impact(changes: DataFrame, objects: DataFrame, usage: DataFrame) -> DataFrame:
    """Severity of each announced change for each object it may touch.

    `changes` holds (change_id, keyword, category_type); `objects` holds
    (object_name, object_type, definition), `usage` (keyword, executions). A keyword
    in the definition is critical, a type match or mere usage a warning.
    """
    holds = fitting_pairs(objects, "definition", changes, "keyword", F.array(F.upper("keyword")), F.expr("contains(upper(definition), upper(keyword))"), F.upper("definition"))
    exact = objects.join(holds, "definition").join(changes, "keyword").select(
        "change_id", "object_name", F.lit(2).alias("_s"), F.concat(F.lit("definition holds "), F.col("keyword")).alias("evidence")
    )
    by_type = objects.join(changes, F.col("object_type") == F.col("category_type")).select(
        "change_id", "object_name", F.lit(1).alias("_s"), F.concat(F.lit("feature area "), F.col("category_type")).alias("evidence")
    )
    used = changes.join(usage.filter("executions > 0"), "keyword").select(
        "change_id", F.lit("").alias("object_name"), F.lit(1).alias("_s"), F.lit("query history").alias("evidence")
    )
    hits = exact.unionByName(by_type).unionByName(used)
    found = hits.groupBy("change_id").agg(
        F.max("_s").alias("_s"),
        F.count_distinct(F.nullif("object_name", F.lit(""))).alias("affected_objects"),
        F.array_join(F.array_sort(F.collect_set("evidence")), "; ").alias("evidence"),
    )
    return changes.join(found, "change_id", "left").select(
        "change_id",
        F.when(F.col("_s") == 2, "CRITICAL").when(F.col("_s") == 1, "WARNING").otherwise("INFO").alias("severity"),
        F.coalesce("affected_objects", F.lit(0)).alias("affected_objects"),
        F.coalesce("evidence", F.lit("")).alias("evidence"),
    )


def remediation_priority(impact: DataFrame) -> DataFrame:
    """Priority and time window by lifecycle and severity; needs lifecycle and severity."""
    rule = None
    for lifecycle, severity, priority in PRIORITIES:
        hit = (F.col("lifecycle") == lifecycle) & (F.col("severity") == severity)
        rule = F.when(hit, priority) if rule is None else rule.when(hit, priority)
    p = F.col("priority")
    window = None
    for priority, text in WINDOWS.items():
        window = F.when(p == priority, text) if window is None else window.when(p == priority, text)
    return impact.withColumn("priority", rule.otherwise("NONE")).withColumn("action_window", window.otherwise("no action"))


