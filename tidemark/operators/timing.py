"""Run-timing analytics: durations, costs, alerts, baselines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import money, null_safe_join, ranked_values, rounded

# Seconds below which a run is an error or too short, above which it is too long.
THRESHOLDS = {
    ("rule-reviewer", "FULL"): {"short": 120, "long": 600, "error": 60},
    ("rule-reviewer", "FOCUSED"): {"short": 60, "long": 360, "error": 30},
    ("rule-reviewer", "STALENESS"): {"short": 30, "long": 240, "error": 15},
    ("plan-reviewer", "FULL"): {"short": 30, "long": 720, "error": 15},
    ("doc-reviewer", "FULL"): {"short": 90, "long": 480, "error": 45},
    ("rule-creator", "default"): {"short": 180, "long": 900, "error": 90},
}

# Price per million input and output tokens for a model without a price of its own.
DEFAULT_PRICE = (5.00, 15.00)

STATUSES = ("completed", "warning", "error", "missing")
GROUP = ["skill_name", "mode", "model"]


def human_duration(seconds: Column) -> Column:
    """Xm Ys form."""
    s = F.floor(seconds)
    return F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))


def seconds_between(end: str, start: str) -> Column:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return (micros(end) - micros(start)) / 1_000_000.0


def finish_runs(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Durations of finished runs; a negative one is an error, below a second a warning."""
    d = F.col("_d")
    return (
        starts.join(ends.select("run_id", "end_ts"), "run_id")
        .withColumn("_d", seconds_between("end_ts", "start_ts"))
        .select(
            "run_id",
            F.when(d >= 0, rounded(d, 2)).alias("duration_seconds"),
            F.when(d >= 0, human_duration(d)).alias("duration_human"),
            F.when(d < 0, "error").when(d < 1, "warning").otherwise("completed").alias("status"),
        )
    )


def checkpoint_elapsed(starts: DataFrame, points: DataFrame) -> DataFrame:
    """Seconds from the start of a run to each of its named checkpoints."""
    return starts.join(points, "run_id").select("run_id", "name", rounded(seconds_between("at", "start_ts"), 2).alias("elapsed_seconds"))


def token_cost(runs: DataFrame, prices: Mapping[str, tuple[float, float]], default: tuple[float, float] = DEFAULT_PRICE) -> DataFrame:
    """Estimated cost of the tokens of each run."""

    def price(side: int) -> Column:
        out = None
        for model, pair in prices.items():
            hit = F.col("model") == model
            out = F.when(hit, F.lit(pair[side])) if out is None else out.when(hit, F.lit(pair[side]))
        return F.lit(default[side]) if out is None else out.otherwise(F.lit(default[side]))

    # exact decimals: a cost that lies between two cents rounds the same everywhere
    micros = F.col("input_tokens") * price(0).cast("decimal(12,4)") + F.col("output_tokens") * price(1).cast("decimal(12,4)")
    cost = rounded(micros.cast("decimal(28,4)") / F.lit(1_000_000).cast("decimal(7,0)"), 4)
    return runs.select(
        "run_id", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), cost.cast("double").alias("estimated_cost_usd")
    )


def threshold(kind: str) -> Column:
    """Limit of a run by skill and mode, or by the default of the skill."""
    out = None
    for (skill, mode), limits in THRESHOLDS.items():
        hit = F.col("skill_name") == skill
        if mode != "default":
            hit = hit & (F.col("mode") == mode)
        out = F.when(hit, F.lit(limits[kind])) if out is None else out.when(hit, F.lit(limits[kind]))
    return out


def alerts(runs: DataFrame) -> DataFrame:
    """One row per alert: too short as an error or a warning, or too long."""
    d = F.col("duration_seconds")
    error, short, long = threshold("error"), threshold("short"), threshold("long")
    first = F.when(d < error, F.struct(F.lit("error_short_duration").alias("type"), error.alias("threshold_seconds"))).when(
        d < short, F.struct(F.lit("warning_short_duration").alias("type"), short.alias("threshold_seconds"))
    )
    second = F.when(d > long, F.struct(F.lit("warning_long_duration").alias("type"), long.alias("threshold_seconds")))
    return runs.select(
        "run_id", rounded(d, 2).alias("actual_seconds"), F.explode(F.array_compact(F.array(first, second))).alias("_a")
    ).select("run_id", F.col("_a.type").alias("alert_type"), F.col("_a.threshold_seconds").cast("bigint").alias("threshold_seconds"), "actual_seconds")


def _mean(c: str) -> Column:
    return F.sum(money(F.col(c))).cast("double") / F.count(c)


def set_baseline(runs: DataFrame, min_samples: int = 5) -> DataFrame:
    """Mean, upper median, 95th percentile by index and population deviation per group."""
    c = "duration_seconds"
    stats = (
        runs.groupBy(*GROUP)
        .agg(F.count(c).alias("sample_size"), rounded(_mean(c), 2).alias("avg_seconds"), rounded(F.stddev_pop(c), 2).alias("stddev_seconds"))
        .filter(F.col("sample_size") >= min_samples)
    )
    marks = ranked_values(runs, GROUP, c, {"median_seconds": 0.5, "p95_seconds": 0.95})
    return null_safe_join(stats, marks, GROUP).select(
        *GROUP, "sample_size", "avg_seconds", rounded("median_seconds", 2).alias("median_seconds"),
        rounded("p95_seconds", 2).alias("p95_seconds"), "stddev_seconds",
    )


def compare_baseline(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each run against its baseline; without a deviation a fifth of the mean is taken."""
    b = baseline.select(*GROUP, F.col("avg_seconds").alias("_avg"), F.coalesce("stddev_seconds", F.col("avg_seconds") * 0.2).alias("_sd"))
    delta = F.col("duration_seconds") - F.col("_avg")
    return null_safe_join(runs, b, GROUP).select(
        "run_id",
        rounded(delta, 2).alias("delta_seconds"),
        rounded(F.try_divide(delta, F.col("_avg")) * 100, 1).alias("delta_percent"),
        F.when(F.abs(delta) <= F.col("_sd"), "within_normal").when(F.abs(delta) <= 2 * F.col("_sd"), "slightly_outside")
        .otherwise("significantly_outside").alias("status"),
    )


def analyze(runs: DataFrame) -> DataFrame:
    """Figures over all runs in one row."""
    c = "duration_seconds"
    all_runs = runs.select(F.lit("all").alias("scope"), c)
    stats = all_runs.groupBy("scope").agg(
        F.count(c).alias("run_count"),
        rounded(F.sum(money(F.col(c))).cast("double"), 2).alias("total_seconds"),
        rounded(_mean(c), 2).alias("avg_seconds"),
        rounded(F.min(c), 2).alias("min_seconds"),
        rounded(F.max(c), 2).alias("max_seconds"),
        rounded(F.stddev_pop(c), 2).alias("stddev_seconds"),
    )
    marks = ranked_values(all_runs, ["scope"], c, {"p5_seconds": 0.05, "p50_seconds": 0.5, "p95_seconds": 0.95})
    return stats.join(marks, "scope")


def validate_runs(runs: DataFrame) -> DataFrame:
    """Errors of each run record as a sorted list; a valid record has none."""
    required = ["run_id", "skill_name", "model", "start_iso", "end_iso", "duration_seconds", "status"]
    found = [F.when(F.col(c).isNull(), F.lit(f"Missing required field: {c}")) for c in required]
    found.append(F.when(~F.col("run_id").rlike("^[a-f0-9]{16}$"), F.concat(F.lit("Invalid run_id format: "), "run_id")))
    found.append(F.when(~F.coalesce(F.col("status"), F.lit("")).isin(*STATUSES), F.concat(F.lit("Invalid status: "), F.coalesce("status", F.lit("None")))))
    found.append(F.when(F.col("duration_seconds") < 0, F.lit("Invalid duration")))
    errors = F.array_sort(F.array_compact(F.array(*found)))
    return runs.select("record_id", errors.alias("errors")).withColumn("is_valid", F.size("errors") == 0)


def exit_class(runs: DataFrame, alert_rows: DataFrame, compared: DataFrame) -> DataFrame:
    """2 for a suspected shortcut, 3 for a run well above its baseline, else 0."""
    short = alert_rows.filter("alert_type = 'error_short_duration'").select("run_id").distinct().withColumn("_s", F.lit(True))
    above = compared.filter("status = 'significantly_outside' and delta_percent > 0").select("run_id").withColumn("_a", F.lit(True))
    return runs.select("run_id").join(short, "run_id", "left").join(above, "run_id", "left").select(
        "run_id", F.when(F.col("_s"), 2).when(F.col("_a"), 3).otherwise(0).cast("bigint").alias("exit_code")
    )


def open_runs(starts: DataFrame, ends: DataFrame, as_of: str, stale_hours: int = 24, purge_days: int = 7) -> DataFrame:
    """Latest unfinished run per skill and agent, and whether it is stale or due to be removed."""
    at = F.lit(as_of).cast("timestamp_ntz")
    latest = (
        starts.join(ends.select("run_id"), "run_id", "left_anti")
        .groupBy("skill_name", "agent")
        .agg(F.max(F.struct("start_ts", "run_id")).alias("_l"))
        .select("skill_name", "agent", F.col("_l.run_id").alias("run_id"), F.col("_l.start_ts").alias("start_ts"))
    )
    return latest.withColumn(
        "state",
        F.when(F.col("start_ts") < at - F.expr(f"INTERVAL '{purge_days}' DAY"), "purge")
        .when(F.col("start_ts") < at - F.expr(f"INTERVAL '{stale_hours}' HOUR"), "stale")
        .otherwise("open"),
    )
