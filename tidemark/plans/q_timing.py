"""Run-timing and business trend queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import timing as T
from tidemark.operators import trends as B
from tidemark.plans.inputs import AS_OF, EVENTS_AS_OF, pick
from tidemark.plans.oracle_inputs import pick as sql_pick
from tidemark.plans.registry import query

_RUNS_CTE = """st AS (SELECT run_id, skill_name, 'A' || CAST(user_id % 10 AS VARCHAR) AS agent, started AS start_ts, user_id, duration_seconds FROM timing_runs),
  en AS (SELECT run_id, start_ts + to_microseconds(CAST(round(duration_seconds * CASE WHEN user_id % 50 = 7 THEN -1 ELSE 1 END * 1000000) AS BIGINT)) AS end_ts
         FROM st WHERE user_id % 9 <> 0)"""


def starts(t):
    return t.timing_runs.select(
        "run_id", "skill_name", F.concat(F.lit("A"), (F.col("user_id") % 10).cast("string")).alias("agent"),
        F.col("started").alias("start_ts"), "user_id", "duration_seconds",
    )


def ends(t):
    sign = F.when(F.col("user_id") % 50 == 7, -1).otherwise(1)
    at = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(F.col("duration_seconds") * sign, 6).cast("decimal(18,6)"))
    return starts(t).filter("user_id % 9 <> 0").select("run_id", (F.col("start_ts") + at).alias("end_ts"))


@query(
    "finish_runs",
    f"""
    WITH {_RUNS_CTE}, d AS (SELECT run_id, (epoch_us(end_ts) - epoch_us(start_ts)) / 1000000.0::DOUBLE AS d FROM st JOIN en USING (run_id))
    SELECT run_id, CASE WHEN d >= 0 THEN round(d, 2) END AS duration_seconds,
      CASE WHEN d >= 0 THEN CAST(CAST(floor(d) AS BIGINT) // 60 AS VARCHAR) || 'm ' || CAST(CAST(floor(d) AS BIGINT) % 60 AS VARCHAR) || 's' END AS duration_human,
      CASE WHEN d < 0 THEN 'error' WHEN d < 1 THEN 'warning' ELSE 'completed' END AS status FROM d
    """,
    ("timing_runs",),
)
def _(t):
    return T.finish_runs(starts(t), ends(t))


@query(
    "checkpoint_elapsed",
    """
    SELECT run_id, n AS name, ((CAST(round(duration_seconds * CASE n WHEN 'loaded' THEN 0.25 ELSE 0.75 END * 1000000) AS BIGINT) + 5000) // 10000) / 100.0::DOUBLE AS elapsed_seconds
    FROM timing_runs, (SELECT unnest(['loaded', 'scored']) AS n)
    """,
    ("timing_runs",),
)
def _(t):
    part = F.explode(F.array(F.struct(F.lit("loaded").alias("name"), F.lit(0.25).alias("f")), F.struct(F.lit("scored").alias("name"), F.lit(0.75).alias("f"))))
    p = starts(t).select("run_id", "start_ts", "duration_seconds", part.alias("p"))
    at = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(F.col("duration_seconds") * F.col("p.f"), 6).cast("decimal(18,6)"))
    points = p.select("run_id", F.col("p.name").alias("name"), (F.col("start_ts") + at).alias("at"))
    return T.checkpoint_elapsed(starts(t), points)


@query(
    "token_cost",
    """
    SELECT run_id, input_tokens + output_tokens AS total_tokens,
      ((input_tokens * CASE model WHEN 'model-a' THEN 3 WHEN 'model-b' THEN 15 ELSE 5 END
        + output_tokens * CASE model WHEN 'model-a' THEN 15 WHEN 'model-b' THEN 75 ELSE 15 END + 50) // 100) / 10000.0::DOUBLE AS estimated_cost_usd
    FROM timing_runs
    """,
    ("timing_runs",),
)
def _(t):
    return T.token_cost(t.timing_runs, {"model-a": (3.0, 15.0), "model-b": (15.0, 75.0)})


_LIMITS = "lim AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', '{m}', {x['error']}, {x['short']}, {x['long']})" for (s, m), x in T.THRESHOLDS.items()
) + ") v(s, m, e, sh, lo))"
_ALERTS = f"""{_LIMITS}, al AS (
  SELECT run_id, alert_type, CAST(threshold_seconds AS BIGINT) AS threshold_seconds, round(d, 2) AS actual_seconds FROM (
    SELECT run_id, duration_seconds AS d, CASE WHEN duration_seconds < e THEN 'error_short_duration' ELSE 'warning_short_duration' END AS alert_type,
      CASE WHEN duration_seconds < e THEN e ELSE sh END AS threshold_seconds
    FROM timing_runs JOIN lim ON s = skill_name AND m IN (mode, 'default') WHERE duration_seconds < greatest(e, sh)
    UNION ALL SELECT run_id, duration_seconds, 'warning_long_duration', lo FROM timing_runs JOIN lim ON s = skill_name AND m IN (mode, 'default') WHERE duration_seconds > lo))"""


@query("alerts", f"WITH {_ALERTS} SELECT * FROM al", ("timing_runs",))
def _(t):
    return T.alerts(t.timing_runs)


_MEAN = "CAST(sum(CAST(duration_seconds AS DECIMAL(20,4))) AS DOUBLE) / count(*)"
_BASE = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY skill_name, mode, model ORDER BY duration_seconds) - 1 AS rn,
    count(*) OVER (PARTITION BY skill_name, mode, model) AS n FROM timing_runs),
  base AS (SELECT skill_name, mode, model, count(*) AS sample_size, round({_MEAN}, 2) AS avg_seconds,
    round(max(duration_seconds) FILTER (rn = n // 2), 2) AS median_seconds,
    round(max(duration_seconds) FILTER (rn = least(n - 1, CAST(floor(n * 0.95::DOUBLE) AS BIGINT))), 2) AS p95_seconds,
    round(stddev_pop(duration_seconds), 2) AS stddev_seconds FROM ranked GROUP BY 1, 2, 3 HAVING count(*) >= 5)"""


@query("set_baseline", f"WITH {_BASE} SELECT * FROM base", ("timing_runs",))
def _(t):
    return T.set_baseline(t.timing_runs)


_COMPARED = f"""{_BASE}, cmp AS (SELECT run_id, round(delta, 2) AS delta_seconds, round(delta / avg_seconds * 100, 1) AS delta_percent,
    CASE WHEN abs(delta) <= sd THEN 'within_normal' WHEN abs(delta) <= 2 * sd THEN 'slightly_outside' ELSE 'significantly_outside' END AS status
  FROM (SELECT r.run_id, b.avg_seconds, coalesce(b.stddev_seconds, b.avg_seconds * 0.2) AS sd, r.duration_seconds - b.avg_seconds AS delta
        FROM timing_runs r JOIN base b USING (skill_name, mode, model)))"""


@query("compare_baseline", f"WITH {_COMPARED} SELECT * FROM cmp", ("timing_runs",))
def _(t):
    return T.compare_baseline(t.timing_runs, T.set_baseline(t.timing_runs))


@query(
    "analyze",
    f"""
    WITH r AS (SELECT *, row_number() OVER (ORDER BY duration_seconds) - 1 AS rn, count(*) OVER () AS n FROM timing_runs)
    SELECT 'all' AS scope, count(*) AS run_count, round(CAST(sum(CAST(duration_seconds AS DECIMAL(20,4))) AS DOUBLE), 2) AS total_seconds,
      round({_MEAN}, 2) AS avg_seconds, round(min(duration_seconds), 2) AS min_seconds, round(max(duration_seconds), 2) AS max_seconds,
      round(stddev_pop(duration_seconds), 2) AS stddev_seconds, max(duration_seconds) FILTER (rn = CAST(floor(n * 0.05::DOUBLE) AS BIGINT)) AS p5_seconds,
      max(duration_seconds) FILTER (rn = n // 2) AS p50_seconds, max(duration_seconds) FILTER (rn = CAST(floor(n * 0.95::DOUBLE) AS BIGINT)) AS p95_seconds
    FROM r
    """,
    ("timing_runs",),
)
def _(t):
    return T.analyze(t.timing_runs)


@query(
    "validate_runs",
    """
    WITH r AS (SELECT run_id AS record_id, CASE user_id % 13 WHEN 0 THEN NULL WHEN 1 THEN 'XYZ' ELSE run_id END AS run_id, skill_name,
        CASE WHEN user_id % 17 = 0 THEN NULL ELSE model END AS model, CASE WHEN user_id % 19 = 3 THEN 'odd' ELSE 'completed' END AS status,
        CASE WHEN user_id % 23 = 5 THEN -duration_seconds ELSE duration_seconds END AS duration_seconds FROM timing_runs),
    e AS (SELECT record_id, list_sort(list_filter([CASE WHEN run_id IS NULL THEN 'Missing required field: run_id' END, CASE WHEN model IS NULL THEN 'Missing required field: model' END,
        CASE WHEN NOT regexp_matches(run_id, '^[a-f0-9]{16}$') THEN 'Invalid run_id format: ' || run_id END,
        CASE WHEN status <> 'completed' THEN 'Invalid status: ' || status END, CASE WHEN duration_seconds < 0 THEN 'Invalid duration' END], lambda x: x IS NOT NULL)) AS errors FROM r)
    SELECT record_id, array_to_string(errors, '; ') AS errors, len(errors) = 0 AS is_valid FROM e
    """,
    ("timing_runs",),
)
def _(t):
    u = F.col("user_id")
    records = t.timing_runs.select(
        F.col("run_id").alias("record_id"),
        F.when(u % 13 == 0, None).when(u % 13 == 1, "XYZ").otherwise(F.col("run_id")).alias("run_id"),
        "skill_name",
        F.when(u % 17 != 0, F.col("model")).alias("model"),
        F.col("started").cast("string").alias("start_iso"),
        F.col("started").cast("string").alias("end_iso"),
        F.when(u % 23 == 5, -F.col("duration_seconds")).otherwise(F.col("duration_seconds")).alias("duration_seconds"),
        F.when(u % 19 == 3, "odd").otherwise("completed").alias("status"),
    )
    return T.validate_runs(records).withColumn("errors", F.array_join("errors", "; "))


@query(
    "exit_class",
    f"""
    WITH {_ALERTS}, {_COMPARED}
    SELECT run_id, CAST(CASE WHEN run_id IN (SELECT run_id FROM al WHERE alert_type = 'error_short_duration') THEN 2
      WHEN run_id IN (SELECT run_id FROM cmp WHERE status = 'significantly_outside' AND delta_percent > 0) THEN 3 ELSE 0 END AS BIGINT) AS exit_code
    FROM timing_runs
    """,
    ("timing_runs",),
)
def _(t):
    r = t.timing_runs
    return T.exit_class(r, T.alerts(r), T.compare_baseline(r, T.set_baseline(r)))


@query(
    "open_runs",
    f"""
    WITH {_RUNS_CTE}
    SELECT skill_name, agent, run_id, start_ts, CASE WHEN start_ts < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY THEN 'purge'
      WHEN start_ts < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 24 HOUR THEN 'stale' ELSE 'open' END AS state
    FROM st WHERE run_id NOT IN (SELECT run_id FROM en)
    QUALIFY row_number() OVER (PARTITION BY skill_name, agent ORDER BY start_ts DESC, run_id DESC) = 1
    """,
    ("timing_runs",),
)
def _(t):
    return T.open_runs(starts(t), ends(t), EVENTS_AS_OF)


# ---- trends ----

_DAY = f"DATE '{AS_OF[:10]}'"


def revenue(t):
    """Orders as revenue rows."""
    return t.table("orders").select(
        F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("revenue")
    )


def feature_revenue(t):
    """Line items as revenue by part type, colour and supplier."""
    p = t.table("part").select("p_partkey", "p_type", "p_brand")
    return t.table("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.to_date("l_shipdate").alias("day"), F.col("p_type").alias("category"), F.col("p_brand").alias("feature"),
        (F.col("l_suppkey") % 20).alias("use_case"), F.col("l_extendedprice").alias("revenue"),
    )


_REV = "rev AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS category, o_totalprice AS revenue FROM orders)"
_FREV = """frev AS (SELECT CAST(l_shipdate AS DATE) AS day, p_type AS category, p_brand AS feature, l_suppkey % 20 AS use_case, l_extendedprice AS revenue
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _sum(cond: str = "true", v: str = "revenue") -> str:
    return f"round(CAST(sum(CASE WHEN {cond} THEN CAST({v} AS DECIMAL(20,4)) ELSE 0 END) AS DOUBLE), 2)"


@query(
    "fiscal_year",
    f"WITH {_REV} SELECT CAST(year(day) + CASE WHEN month(day) >= 2 THEN 1 ELSE 0 END AS BIGINT) AS fiscal_year, count(*) AS row_count, {_sum()} AS revenue FROM rev GROUP BY 1",
)
def _(t):
    return B.by_fiscal_year(revenue(t))


@query(
    "year_over_year",
    f"""WITH {_REV} SELECT category, {_sum("day BETWEEN DATE '2000-02-01' AND DATE '2001-01-31'")} AS lookback_revenue,
        {_sum("day BETWEEN DATE '1999-02-01' AND DATE '2000-01-31'")} AS prior_revenue FROM rev GROUP BY 1""",
)
def _(t):
    return B.year_over_year(revenue(t), AS_OF)


@query(
    "monthly_growth",
    f"""
    WITH {_REV}, m AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, {_sum()} AS monthly_revenue FROM rev WHERE day >= {_DAY} - INTERVAL 18 MONTH GROUP BY 1),
    l AS (SELECT *, lag(monthly_revenue) OVER (ORDER BY month) AS prior_month FROM m)
    SELECT *, round((monthly_revenue - prior_month) / nullif(prior_month, 0) * 100, 2) AS growth_pct FROM l
    """,
)
def _(t):
    return B.monthly_growth(revenue(t), AS_OF)


@query(
    "monthly_trend",
    f"WITH {_REV} SELECT CAST(date_trunc('month', day) AS DATE) AS month, {_sum()} AS monthly_revenue FROM rev WHERE day >= {_DAY} - INTERVAL 12 MONTH GROUP BY 1",
)
def _(t):
    return B.monthly_trend(revenue(t), AS_OF)


@query(
    "category_momentum",
    f"""
    WITH {_REV}, s AS (SELECT category, {_sum(f"day >= {_DAY} - INTERVAL 3 MONTH")} AS last_3m,
      {_sum(f"day >= {_DAY} - INTERVAL 6 MONTH AND day < {_DAY} - INTERVAL 3 MONTH")} AS prior_3m FROM rev GROUP BY 1)
    SELECT *, round((last_3m - prior_3m) / nullif(prior_3m, 0) * 100, 2) AS growth_pct FROM s WHERE last_3m > 0 OR prior_3m > 0
    """,
)
def _(t):
    return B.category_momentum(revenue(t), AS_OF)


_TYPES = ["NEW", "EXPANSION", "RENEWAL"]
_RIVALS = ["Rival A", "Rival B", "Rival C", "Rival D"]


def deals(t):
    """Orders as deals: status F is won, P is lost, O is open."""
    k = F.col("o_orderkey")
    return t.table("orders").select(
        k.alias("deal_id"),
        B.fiscal_year(F.to_date("o_orderdate")).alias("fiscal_year"),
        pick(_TYPES, k).alias("deal_type"),
        F.col("o_orderpriority").alias("stage"),
        F.when(k % 31 != 0, F.col("o_totalprice")).alias("deal_value"),
        (F.col("o_orderstatus") == "F").alias("is_won"),
        (F.col("o_orderstatus") == "P").alias("is_lost"),
        F.when(k % 5 != 0, pick(_RIVALS, F.col("o_custkey"))).alias("competitor"),
        F.to_date("o_orderdate").alias("close_date"),
        F.when(k % 3 == 2, F.col("o_totalprice")).otherwise(0.0).alias("renewal_value"),
    )


_DEALS = f"""deals AS (SELECT o_orderkey AS deal_id, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 2 THEN 1 ELSE 0 END AS BIGINT) AS fiscal_year,
  {sql_pick(_TYPES, "o_orderkey")} AS deal_type, o_orderpriority AS stage, CASE WHEN o_orderkey % 31 <> 0 THEN o_totalprice END AS deal_value,
  o_orderstatus = 'F' AS is_won, o_orderstatus = 'P' AS is_lost, CASE WHEN o_orderkey % 5 <> 0 THEN {sql_pick(_RIVALS, "o_custkey")} END AS competitor,
  CAST(o_orderdate AS DATE) AS close_date, CASE WHEN o_orderkey % 3 = 2 THEN o_totalprice ELSE 0.0 END AS renewal_value FROM orders)"""


@query(
    "win_loss",
    f"""
    WITH {_DEALS} SELECT fiscal_year, deal_type, stage, count(*) AS deal_count, {_sum(v="deal_value")} AS total_value, count(*) FILTER (is_won) AS wins,
      count(*) FILTER (is_lost) AS losses, {_sum("is_won", "deal_value")} AS won_value, {_sum("is_lost", "deal_value")} AS lost_value,
      coalesce(string_agg(DISTINCT competitor, ', ' ORDER BY competitor), '') AS competitors FROM deals GROUP BY 1, 2, 3
    """,
)
def _(t):
    return B.win_loss(deals(t))


@query(
    "top_features",
    f"WITH {_FREV} SELECT category, feature, {_sum()} AS revenue FROM frev WHERE day >= {_DAY} - INTERVAL 3 MONTH GROUP BY 1, 2 ORDER BY revenue DESC, 1, 2 LIMIT 50",
)
def _(t):
    return B.top_features(feature_revenue(t), AS_OF)


@query(
    "feature_adoption",
    f"""WITH {_FREV} SELECT category, feature, count(DISTINCT use_case) AS use_case_count, {_sum()} AS total_revenue
        FROM frev WHERE day >= {_DAY} - INTERVAL 6 MONTH GROUP BY 1, 2 ORDER BY total_revenue DESC, 1, 2 LIMIT 30""",
)
def _(t):
    return B.feature_adoption(feature_revenue(t), AS_OF)


def items(t):
    return t.table("orders").select(
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("risk"),
        F.concat(F.lit("Case "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_totalprice").alias("item_value"),
    )


@query(
    "risk_summary",
    f"""SELECT o_orderstatus AS status, o_orderpriority AS risk, count(*) AS item_count, {_sum(v="o_totalprice")} AS total_value,
        round({_sum(v="o_totalprice")} * 100.0::DOUBLE / (SELECT {_sum(v="o_totalprice")} FROM orders), 2) AS share_pct FROM orders GROUP BY 1, 2""",
)
def _(t):
    return B.risk_summary(items(t))


@query(
    "risk_items",
    """SELECT o_orderstatus AS status, o_orderpriority AS risk, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice DESC, 'Case ' || CAST(o_orderkey AS VARCHAR)) AS position,
        'Case ' || CAST(o_orderkey AS VARCHAR) AS name, o_totalprice AS item_value FROM orders""",
)
def _(t):
    return B.risk_items(items(t))


@query(
    "open_items",
    f"WITH {_DEALS} SELECT deal_id, deal_type, stage, deal_value, close_date FROM deals WHERE NOT is_won AND NOT is_lost",
)
def _(t):
    return B.open_items(deals(t))


@query(
    "lost_items",
    f"WITH {_DEALS} SELECT deal_id, close_date, deal_value, competitor FROM deals WHERE is_lost ORDER BY close_date DESC, deal_id LIMIT 20",
)
def _(t):
    return B.lost_items(deals(t))


@query("renewals", f"WITH {_DEALS} SELECT deal_id, renewal_value, close_date, stage FROM deals WHERE renewal_value > 0")
def _(t):
    return B.renewals(deals(t))
