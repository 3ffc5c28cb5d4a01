"""Drift between artifacts and their sources, and data-quality scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import as_large, numbered, percent, pick_bounded, rounded
from tidemark.functions.naming import is_staging_like
from tidemark.operators.catalog import TABLE_KEY, full_name, profile_values
from tidemark.operators.usage import days_between, since

# Name parts that raise or lower the score of a new column.
USEFUL_WORD = "AMOUNT|PRICE|STATUS|TYPE|DATE|NAME|CODE|ID|COUNT"
AUDIT_WORD = "_AT|_ETL|_LOAD|_BATCH|_DW_|_TS_|SRC_|META_"
PII_WORD = "EMAIL|SSN|PHONE|DOB|ADDRESS"
ETL_TABLE = "_LOG|_AUDIT|_HIST|_STG|_RAW"
QUERYABLE = ("VARCHAR", "NUMBER", "DATE", "TIMESTAMP")
COMPLEX = ("VARIANT", "OBJECT", "ARRAY")

# Signals of readiness with weight, lower bound of green and of yellow, and direction.
READINESS = (
    ("table_comment_pct", 20, 60, 30, "up"),
    ("column_comment_pct", 15, 50, 20, "up"),
    ("query_volume", 15, 100, 20, "up"),
    ("user_count", 10, 5, 2, "up"),
    ("error_rate_pct", 10, 3, 10, "down"),
    ("fk_pct", 10, 50, 20, "up"),
    ("days_since_change", 10, 7, 60, "down"),
    ("pii_unmasked", 10, 1, 2, "down"),
)

TYPE_ORDER = ("TABLE_GAP", "NEW_COLUMN", "COLUMN_GAP", "TYPE_DRIFT", "INDEX_GAP")


def recommendation(score: Column) -> Column:
    return F.when(score >= 4, "ADD").when(score >= 1, "REVIEW").otherwise("SKIP")


def term(condition: Column, value: int) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(0)


def schema_diff(derived: DataFrame, source: DataFrame) -> DataFrame:
    """Columns new or dropped in the source, and shared ones whose type changed or widened."""
    d = derived.select(*TABLE_KEY, F.upper("column_name").alias("column_name"), *[F.col(c).alias(f"_d_{c}") for c in ("data_type", "numeric_precision", "char_length")])
    s = source.select(*TABLE_KEY, F.upper("column_name").alias("column_name"), *[F.col(c).alias(f"_s_{c}") for c in ("data_type", "numeric_precision", "char_length")])
    both = d.join(s, [*TABLE_KEY, "column_name"], "full_outer")
    drift = (
        F.when(F.col("_d_data_type").isNull(), "NEW_IN_SOURCE")
        .when(F.col("_s_data_type").isNull(), "DROPPED_IN_SOURCE")
        .when(F.col("_d_data_type") != F.col("_s_data_type"), "TYPE_CHANGE")
        .when(F.col("_d_numeric_precision") < F.col("_s_numeric_precision"), "PRECISION_WIDENED")
        .when(F.col("_d_char_length") < F.col("_s_char_length"), "LENGTH_WIDENED")
    )
    k = F.col("drift_type")
    return (
        both.withColumn("drift_type", drift)
        .filter(k.isNotNull())
        .select(
            *TABLE_KEY, "column_name", "drift_type",
            F.when(k.isin("DROPPED_IN_SOURCE", "TYPE_CHANGE"), "HIGH").when(k == "PRECISION_WIDENED", "MED").when(k == "LENGTH_WIDENED", "LOW").otherwise("INFO").alias("severity"),
            F.when(k.isin("DROPPED_IN_SOURCE", "TYPE_CHANGE"), "ADD").otherwise("REVIEW").alias("recommendation"),
        )
    )


def score_new_column(columns: DataFrame) -> DataFrame:
    """Points for taking a new column over; needs column_count, and all_null where it was probed."""
    n, t = F.upper("column_name"), F.upper("data_type")
    late = F.col("ordinal") > F.col("column_count") - 2
    early = F.col("ordinal") * 2 <= F.col("column_count")
    audit = n.rlike(AUDIT_WORD)
    score = (
        term(~audit, 3) + term(n.rlike(USEFUL_WORD), 2) + term(t.isin(*QUERYABLE), 1) + term(late, 1) - term(audit, 3)
        - term(t.isin(*COMPLEX), 2) - term(n.rlike(PII_WORD), 2) - term(F.col("nullable") & early, 1) - term(F.col("all_null"), 3)
    )
    return columns.select(*TABLE_KEY, "column_name", score.cast("bigint").alias("score")).withColumn("recommendation", recommendation(F.col("score")))


def null_probe(table: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Values that are not null per column, in one pass; a column without any is not ready."""
    names = list(columns or table.columns)
    return table.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "column_name", "non_null_count").withColumn(
        "is_ready", F.col("non_null_count") > 0
    )


def score_table_gap(candidates: DataFrame, column_counts: DataFrame, view_columns: int, clean_joins: Sequence[str] = ()) -> DataFrame:
    """Points for adding a co-queried table; `column_counts` holds (candidate_table, column_count)."""
    p, n = F.col("pct_of_queries"), F.col("column_count")
    score = (
        F.when(p >= 30, 3).when(p >= 10, 2).when(p >= 5, 1).otherwise(0) + term(F.col("unique_users") >= 5, 2) + term(n <= 10, 1) - term(n > 30, 2)
        - term(n + view_columns > 100, 3) - term(F.col("candidate_table").rlike(ETL_TABLE), 3) + term(F.col("candidate_table").isin(*clean_joins), 1)
    )
    return candidates.join(column_counts, "candidate_table", "left").withColumn("score", score.cast("bigint")).withColumn("recommendation", recommendation(F.col("score")))


def score_column_gap(candidates: DataFrame, synonyms: Sequence[str] = ()) -> DataFrame:
    """Points for adding a column that queries use."""
    c, u = F.col("candidate_col"), F.col("usage_contexts")
    score = (
        term(u.contains("filter"), 3) + term(u.contains("group_by"), 2) + term(F.col("unique_users") >= 3, 2) + term(F.col("query_count") >= 10, 1)
        - term(c.rlike(AUDIT_WORD), 3) - term(c.rlike("EMAIL|SSN|PHONE|DOB"), 2) - term(c.isin(*synonyms), 2)
    )
    return candidates.withColumn("score", score.cast("bigint")).withColumn("recommendation", recommendation(F.col("score")))


def dimension_samples(table: DataFrame, documented: Sequence[str] = (), n: int = 10) -> DataFrame:
    """First values of the text dimensions whose values nobody documented; always worth adding."""
    names = [f.name for f in table.schema.fields if f.dataType.simpleString() == "string" and f.name not in documented]
    return profile_values(table.select(*names), n).withColumn("recommendation", F.lit("ADD"))


def refresh_health(history: DataFrame, as_of: str, lag_hours: int, newest: int = 20, days: int = 3, wide_days: int = 7) -> DataFrame:
    """State of each object's latest refreshes; the window widens when the short one is empty."""
    recent = since("ts", as_of, days)
    both = history.filter(since("ts", as_of, wide_days)).withColumn("_short", recent)
    has = both.groupBy("object_name").agg(F.max("_short").alias("_any"))
    inside = both.join(has, "object_name").filter(F.col("_short") | ~F.col("_any"))
    last = pick_bounded(inside, ["object_name"], [F.desc("ts"), F.desc("run_id")], newest)
    g = last.groupBy("object_name").agg(
        F.count(F.lit(1)).alias("refreshes"), F.count_if(F.col("state") == "FAILED").alias("failed"), F.max_by("state", F.struct("ts", "run_id")).alias("last_state"), F.max("ts").alias("last_refresh")
    )
    stale = F.col("last_refresh") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL '{2 * lag_hours}' HOUR")
    return g.withColumn("health", F.when(F.col("failed") > 0, "FAILED").when(stale, "STALE").otherwise("OK"))


def error_rate_daily(events: DataFrame) -> DataFrame:
    """Requests and errors per day."""
    return events.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if(F.col("status") == "ERROR").alias("error_count"),
        percent(F.count_if(F.col("status") == "ERROR"), F.count(F.lit(1))).alias("error_pct"),
    )


def unanswered_intents(events: DataFrame, top: int = 20) -> DataFrame:
    """Failing questions (whole texts) by status and message, most frequent first."""
    n = F.col("occurrence_count")
    return (
        events.filter((F.col("status") == "ERROR") | F.col("error_message").isNotNull())
        .groupBy(F.col("question").alias("sample_question"), "status", "error_message")
        .agg(F.count(F.lit(1)).alias("occurrence_count"))
        .orderBy(F.desc("occurrence_count"), "sample_question", "status", F.asc_nulls_first("error_message"))
        .limit(top)
        .withColumn("priority", F.when(n >= 10, "HIGH").when(n >= 3, "MED").otherwise("LOW"))
    )


def tool_failures(events: DataFrame, add_above: float = 20.0) -> DataFrame:
    """Calls, errors and a sample message per tool."""
    bad = F.col("status") == "ERROR"
    return events.groupBy("tool_name").agg(
        F.count(F.lit(1)).alias("call_count"), F.count_if(bad).alias("error_count"), percent(F.count_if(bad), F.count(F.lit(1))).alias("error_pct"),
        F.min("error_message").alias("sample_error"),
    ).withColumn("recommendation", F.when(F.col("error_pct") > add_above, "ADD").otherwise("NONE"))


def drift_manifest(suggestions: DataFrame) -> DataFrame:
    """All suggestions in one numbered list: dropped columns first, then score and kind.

    Needs item, kind, severity, drift_type, score, recommendation. Bypass rows stay
    informational.
    """
    order = None
    for i, name in enumerate(TYPE_ORDER):
        hit = F.col("kind") == name
        order = F.when(hit, i) if order is None else order.when(hit, i)
    severity = F.when(F.col("drift_type") == "DROPPED_IN_SOURCE", 0).when(F.col("severity") == "HIGH", 1).when(F.col("severity") == "MED", 2).when(F.col("severity") == "LOW", 3).otherwise(4)
    ranked = suggestions.withColumns({"_sev": severity, "_neg": -F.coalesce("score", F.lit(0)), "_kind": order.otherwise(len(TYPE_ORDER))})
    ranked = ranked.withColumn("_id", F.concat_ws("|", "kind", "item"))
    return numbered(ranked, [], ["_sev", "_neg", "_kind"], "_id", "number").select(
        "number", "kind", "item", "severity", "score", F.when(F.col("kind") == "BYPASS", "INFO").otherwise(F.col("recommendation")).alias("recommendation")
    )


def apply_approvals(manifest: DataFrame, choices: DataFrame | None = None, rule: str | None = None) -> DataFrame:
    """Approved rows: by number, or by a bulk rule (all ADD, HIGH, all); SKIP is never approved in bulk."""
    kept = None
    bulk = {
        "all ADD": F.col("recommendation") == "ADD",
        "HIGH": (F.col("severity") == "HIGH") & (F.col("recommendation") != "SKIP"),
        "all": ~F.col("recommendation").isin("SKIP", "INFO"),
    }
    if rule is not None:
        kept = manifest.filter(bulk[rule])
    if choices is not None:
        picked = manifest.join(as_large(choices.filter("choice = 'A'").select("number")), "number", "left_semi")
        refused = choices.filter("choice = 'S'").select("number")
        kept = picked if kept is None else kept.unionByName(picked).distinct().join(as_large(refused), "number", "left_anti")
    if kept is None:
        raise ValueError("name a rule or pass choices")
    return kept


def freshness(objects: DataFrame, as_of: str, warn: int = 2, stale: int = 3) -> DataFrame:
    """Lag of active objects against a multiple of their target; needs object_name, data_ts, target_lag_sec, is_active."""
    lag = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.col("data_ts").cast("timestamp"))) / 1_000_000)
    return (
        objects.filter("is_active").withColumn("lag_sec", lag)
        .select("object_name", "target_lag_sec", "lag_sec", F.when(F.col("lag_sec") > stale * F.col("target_lag_sec"), "STALE").when(F.col("lag_sec") > warn * F.col("target_lag_sec"), "WARN").alias("status"))
        .filter(F.col("status").isNotNull())
    )


def empty_tables(tables: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """Base tables without rows; after a fix an empty one is a sign of a regression."""
    empty = tables.filter((F.col("table_type") == "BASE TABLE") & (F.col("row_count") == 0)).select(full_name().alias("full_name"))
    if fixed is None:
        return empty.withColumn("status", F.lit("EMPTY"))
    f = fixed.select("full_name").distinct().withColumn("_f", F.lit(True))
    return empty.join(f, "full_name", "left").select("full_name", F.when(F.col("_f"), "WARNING_REGRESSION").otherwise("EMPTY").alias("status"))


def baseline_drift(baseline: DataFrame | None, columns: DataFrame) -> DataFrame:
    """New, removed and retyped columns against a stored baseline; the first run finds nothing."""
    key = [*TABLE_KEY, "column_name"]
    b = (columns if baseline is None else baseline).select(*key, F.col("data_type").alias("old_type"))
    n = columns.select(*key, F.col("data_type").alias("new_type"))
    change = F.when(F.col("old_type").isNull(), "NEW").when(F.col("new_type").isNull(), "REMOVED").when(F.col("old_type") != F.col("new_type"), "TYPE_CHANGED")
    return b.join(n, key, "full_outer").withColumn("change", change).filter(F.col("change").isNotNull())


def comment_coverage(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Documented tables and columns, and text-typed columns, per schema in percent."""
    key = ["database_name", "schema_name"]
    t = tables.filter("table_type = 'BASE TABLE'").groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_tables"), percent(F.count("comment"), F.count(F.lit(1))).alias("table_comment_pct")
    )
    c = columns.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_columns"), percent(F.count("comment"), F.count(F.lit(1))).alias("column_comment_pct"),
        percent(F.count_if(F.col("data_type").isin("TEXT", "VARCHAR")), F.count(F.lit(1))).alias("text_pct"),
    )
    return c.join(t, key, "left")


def readiness_score(signals: DataFrame) -> DataFrame:
    """Weighted score of eight signals per domain, with the path it leads to.

    Green counts full, yellow half; a blocking flag stops whatever the score.
    """
    total, reds = F.lit(0.0), []
    for name, weight, green, yellow, direction in READINESS:
        v = F.col(name)
        if direction == "up":
            band = F.when(v > green, 1.0).when(v >= yellow, 0.5).otherwise(0.0)
        else:
            band = F.when(v < green, 1.0).when(v <= yellow, 0.5).otherwise(0.0)
        total = total + F.lit(weight) * band
        reds.append(F.when(band == 0.0, F.lit(name)))
    return signals.select(
        "domain", rounded(total, 1).alias("score"), F.array_join(F.array_compact(F.array(*reds)), ",").alias("red_signals"),
        F.when(F.col("is_blocked"), "BLOCKED").when(total >= 75, "CLEAN").when(total >= 40, "ASK").otherwise("ENRICH").alias("path"),
    )


def metric_conflicts(columns: DataFrame, more_than: int = 2) -> DataFrame:
    """Numeric columns whose name occurs in more than a few tables."""
    names = columns.groupBy("column_name").agg(F.count_distinct(*TABLE_KEY).alias("table_count")).filter(F.col("table_count") > more_than)
    return columns.filter(F.col("data_type").isin("NUMBER", "FLOAT", "DECIMAL")).join(names, "column_name").select("column_name", full_name().alias("full_name"), "data_type", "table_count")


def entity_conflicts(tables: DataFrame, pattern: str, min_ratio: float = 10.0) -> DataFrame:
    """Tables of one concept per database whose row counts lie far apart."""
    hit = tables.filter(F.upper("table_name").rlike(pattern) & (F.col("row_count") > 0))
    span = hit.groupBy("database_name").agg(F.max("row_count").alias("_hi"), F.min("row_count").alias("_lo"))
    return (
        hit.join(span, "database_name")
        .filter(F.col("_hi") >= F.col("_lo") * min_ratio)
        .select(full_name().alias("full_name"), "row_count", rounded(F.col("_hi") / F.col("row_count"), 2).alias("ratio_to_largest"))
    )


# Points that an external tool adds to the trust in a definition.
TOOL_BOOST = {"metrics_layer": 35, "bi_measure": 30, "calculated_field": 25}


def trust_score(definitions: DataFrame) -> DataFrame:
    """Trust in each competing definition, relative to the most used one of its metric.

    Needs metric, definition, executions, users, scheduled, errors, recent, earlier,
    top_user_executions and tool (or null).
    """
    peaks = definitions.groupBy("metric").agg(*[F.max(c).alias(f"_{c}") for c in ("executions", "users", "scheduled")])
    part = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(f"_{c}")), F.lit(0.0))
    error_rate = F.try_divide(F.col("errors").cast("double"), F.col("executions"))
    trend = F.when(F.col("recent") > F.col("earlier"), 1.0).when(F.col("recent") == F.col("earlier"), 0.5).otherwise(0.0)
    base = part("executions") * 30 + part("users") * 25 + part("scheduled") * 20 + (1 - F.least(F.coalesce(error_rate, F.lit(0.0)) * 10, F.lit(1.0))) * 15 + trend * 10
    boost = F.lit(0)
    for tool, extra in TOOL_BOOST.items():
        boost = boost + F.when(F.col("tool") == tool, extra).otherwise(0)
    single = F.col("top_user_executions") > F.col("executions") * 0.8
    return definitions.join(peaks, "metric").select(
        "metric", "definition", rounded(F.least(base + boost, F.lit(100.0)), 1).alias("score"), single.alias("single_user"), (F.coalesce(error_rate, F.lit(0.0)) > 0.1).alias("high_error")
    )


def documentation_gaps(tables: DataFrame, columns: DataFrame, used_columns: DataFrame, constraints: DataFrame, big_rows: int = 10_000) -> DataFrame:
    """Gaps in documentation and relations; `used_columns` holds column_name."""
    bare = F.coalesce(F.col("comment"), F.lit("")) == ""
    base = tables.filter("table_type = 'BASE TABLE'")
    undocumented = base.filter(bare).select(full_name().alias("item"), F.lit("UNDOCUMENTED_TABLE").alias("gap"))
    columns_used = (
        columns.filter(bare).join(used_columns.select(F.upper("column_name").alias("_u")).distinct(), F.upper("column_name") == F.col("_u"), "left_semi")
        .select(F.concat_ws(".", full_name(), "column_name").alias("item"), F.lit("UNDOCUMENTED_USED_COLUMN").alias("gap"))
    )
    noted = columns.filter(~bare).select(*TABLE_KEY).distinct()
    silent = base.filter(bare & (F.col("row_count") > big_rows)).join(noted, TABLE_KEY, "left_anti").select(full_name().alias("item"), F.lit("LARGE_WITHOUT_TEXT").alias("gap"))
    key = ["database_name", "schema_name"]
    no_links = tables.select(*key).distinct().join(constraints.select(*key).distinct(), key, "left_anti").select(F.concat_ws(".", *key).alias("item"), F.lit("NO_FOREIGN_KEYS").alias("gap"))
    return undocumented.unionByName(columns_used).unionByName(silent).unionByName(no_links)


def large_unclustered(tables: DataFrame, domain_tables: DataFrame, min_rows: int = 100_000_000) -> DataFrame:
    """Large tables of a domain without a clustering key."""
    return (
        tables.withColumn("full_name", full_name())
        .filter((F.col("row_count") > min_rows) & (F.coalesce(F.col("clustering_key"), F.lit("")) == ""))
        .join(domain_tables.select("full_name").distinct(), "full_name", "left_semi")
        .select("full_name", "row_count")
    )


def recent_domain_changes(tables: DataFrame, domain_tables: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Domain tables altered in the last days."""
    return (
        tables.withColumn("full_name", full_name())
        .filter(F.col("last_altered") > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL '{days}' DAY"))
        .join(domain_tables.select("full_name").distinct(), "full_name", "left_semi")
        .select("full_name", days_between(as_of, "last_altered").alias("days_since_change"))
    )


def auto_exclusions(tables: DataFrame, used: DataFrame) -> DataFrame:
    """Tables left out on their own: staging names, or no query in the window; `used` holds full_name."""
    u = used.select(F.upper("full_name").alias("_u")).distinct()
    named = tables.select(full_name().alias("full_name"), is_staging_like(F.col("table_name")).alias("_s"))
    j = named.join(u, F.upper("full_name") == F.col("_u"), "left")
    return j.select("full_name", F.when(F.col("_s"), "STAGING").when(F.col("_u").isNull(), "DORMANT").otherwise("KEEP").alias("decision"))


def column_exclusions(usage: DataFrame, min_queries: int = 3) -> DataFrame:
    """Columns left out for rare use, and those used in filters only; needs candidate_col, query_count, usage_contexts."""
    return usage.select(
        "candidate_col", "query_count",
        F.when(F.col("query_count") < min_queries, "EXCLUDE").when(F.col("usage_contexts") == "filter", "FILTER_DIMENSION").otherwise("KEEP").alias("decision"),
    )


def resolve_gaps(gaps: DataFrame, definitions: DataFrame, ask: int = 15, min_share: float = 20.0) -> DataFrame:
    """Gaps answered by supplied definitions, and the ones worth asking about.

    Needs gap_id, item, is_blocking, share_pct, trust; definitions hold (item, boost).
    """
    d = definitions.groupBy("item").agg(F.max("boost").alias("_b"))
    joined = gaps.join(d, "item", "left")
    open_ = joined.filter(F.col("_b").isNull() & (F.col("is_blocking") | (F.col("share_pct") > min_share)))
    first = open_.orderBy(F.desc("is_blocking"), F.desc("share_pct"), "gap_id").limit(ask).select("gap_id", F.lit(True).alias("_ask"))
    return joined.join(F.broadcast(first), "gap_id", "left").select(  # at most `ask` rows
        "gap_id", "item", F.when(F.col("_b").isNotNull(), "CONFIRMED").when(F.col("_ask"), "ASK").otherwise("DEFAULT_LOW_CONFIDENCE").alias("resolution"),
        F.least(F.col("trust") + F.coalesce("_b", F.lit(0)), F.lit(100)).cast("bigint").alias("trust"),
    )


GATE_REQUIRED = ("entities", "conflicts_decided", "golden_records", "metrics", "questions", "target_role", "pii_resolved", "access_checked")


def domain_gate(domains: DataFrame) -> DataFrame:
    """Whether a domain may go on: eight conditions that must hold, and four warnings.

    Counts: entities, open_blocking, unknown_entities, metrics, questions, inferred_relations,
    low_confidence, federated_metrics; flags: target_role, pii_resolved, access_checked, has_tool.
    """
    checks = {
        "entities": F.col("entities") >= 1, "conflicts_decided": F.col("open_blocking") == 0, "golden_records": F.col("unknown_entities") == 0,
        "metrics": F.col("metrics") >= 1, "questions": F.col("questions") >= 3, "target_role": F.col("has_target_role"),
        "pii_resolved": F.col("pii_ok"), "access_checked": F.col("access_ok"),
    }
    warnings = {
        "inferred_relations": F.col("inferred_relations") > 0, "low_confidence": F.col("low_confidence") > 0, "federated_metrics": F.col("federated_metrics") > 0, "no_tool": ~F.col("has_tool"),
    }
    missing = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])), ",")
    warned = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in warnings.items()])), ",")
    return domains.select("domain", missing.alias("missing"), warned.alias("warnings")).withColumn("gate", F.when(F.col("missing") == "", "PASS").otherwise("HALT"))
