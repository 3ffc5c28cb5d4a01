"""Business trends by fiscal year, month, category and deal."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.exact import money, numbered_in_order, percent, rounded, text_list


def fiscal_year(date: Column, start_month: int = 2) -> Column:
    """Year in which the fiscal year of a date ends."""
    return F.year(F.add_months(date, 0 if start_month == 1 else 13 - start_month)).cast("bigint")


def fiscal_ranges(as_of: str, start_month: int = 2) -> dict[str, tuple[str, str]]:
    """First and last day of the look-back year and the year before it."""
    day = dt.date.fromisoformat(as_of[:10])
    current = day.year + (1 if start_month > 1 and day.month >= start_month else 0)
    look_back = current - 1

    def bounds(year: int) -> tuple[str, str]:
        first = dt.date(year - 1 if start_month > 1 else year, start_month, 1)
        last = dt.date(first.year + 1, start_month, 1) - dt.timedelta(days=1)
        return first.isoformat(), last.isoformat()

    return {"look_back": bounds(look_back), "prior": bounds(look_back - 1)}


def by_fiscal_year(revenue: DataFrame, start_month: int = 2) -> DataFrame:
    """Rows and total per fiscal year."""
    return revenue.groupBy(fiscal_year(F.col("day"), start_month).alias("fiscal_year")).agg(
        F.count(F.lit(1)).alias("row_count"), total("revenue").alias("revenue")
    )


def total(value: str, condition: Column | None = None) -> Column:
    """Exact sum, as a double with two decimals."""
    v = money(F.col(value))
    if condition is not None:
        v = F.when(condition, v).otherwise(F.lit(0).cast("decimal(20,4)"))
    return rounded(F.sum(v).cast("double"), 2)


def year_over_year(revenue: DataFrame, as_of: str, start_month: int = 2) -> DataFrame:
    """Totals of the look-back year and the year before it per category."""
    r = fiscal_ranges(as_of, start_month)
    inside = lambda b: F.col("day").between(F.lit(b[0]).cast("date"), F.lit(b[1]).cast("date"))
    return revenue.groupBy("category").agg(
        total("revenue", inside(r["look_back"])).alias("lookback_revenue"), total("revenue", inside(r["prior"])).alias("prior_revenue")
    )


def monthly_growth(revenue: DataFrame, as_of: str, months: int = 18) -> DataFrame:
    """Monthly totals with the previous month and the growth in percent.

    The window runs over one row per month, after the aggregation.
    """
    start = F.add_months(F.lit(as_of[:10]).cast("date"), -months)
    monthly = (
        revenue.filter(F.col("day") >= start)
        .groupBy(F.trunc("day", "month").alias("month"))
        .agg(total("revenue").alias("monthly_revenue"))
    )
    prior = F.lag("monthly_revenue").over(Window.orderBy("month"))
    return monthly.withColumn("prior_month", prior).withColumn(
        "growth_pct", rounded(F.try_divide(F.col("monthly_revenue") - F.col("prior_month"), F.col("prior_month")) * 100, 2)
    )


def monthly_trend(revenue: DataFrame, as_of: str, months: int = 12) -> DataFrame:
    """Totals of the last months, latest first."""
    start = F.add_months(F.lit(as_of[:10]).cast("date"), -months)
    return (
        revenue.filter(F.col("day") >= start)
        .groupBy(F.trunc("day", "month").alias("month"))
        .agg(total("revenue").alias("monthly_revenue"))
        .orderBy(F.desc("month"))
    )


def category_momentum(revenue: DataFrame, as_of: str) -> DataFrame:
    """Last three months against the three before, per category."""
    end = F.lit(as_of[:10]).cast("date")
    near, far = F.add_months(end, -3), F.add_months(end, -6)
    return (
        revenue.filter(F.col("day") >= far)
        .groupBy("category")
        .agg(total("revenue", F.col("day") >= near).alias("last_3m"), total("revenue", F.col("day") < near).alias("prior_3m"))
        .filter((F.col("last_3m") > 0) | (F.col("prior_3m") > 0))
        .withColumn("growth_pct", rounded(F.try_divide(F.col("last_3m") - F.col("prior_3m"), F.col("prior_3m")) * 100, 2))
    )


def win_loss(deals: DataFrame) -> DataFrame:
    """Deals won and lost per fiscal year, type and stage, with the competitors met."""
    return deals.groupBy("fiscal_year", "deal_type", "stage").agg(
        F.count(F.lit(1)).alias("deal_count"),
        total("deal_value").alias("total_value"),
        F.count_if("is_won").alias("wins"),
        F.count_if("is_lost").alias("losses"),
        total("deal_value", F.col("is_won")).alias("won_value"),
        total("deal_value", F.col("is_lost")).alias("lost_value"),
        text_list(F.col("competitor"), ", ").alias("competitors"),
    )


def top_features(revenue: DataFrame, as_of: str, months: int = 3, top: int = 50) -> DataFrame:
    """Features with the highest total of the last months."""
    start = F.add_months(F.lit(as_of[:10]).cast("date"), -months)
    return (
        revenue.filter(F.col("day") >= start)
        .groupBy("category", "feature")
        .agg(total("revenue").alias("revenue"))
        .orderBy(F.desc("revenue"), "category", "feature")
        .limit(top)
    )


def feature_adoption(revenue: DataFrame, as_of: str, months: int = 6, top: int = 30) -> DataFrame:
    """Features with the number of distinct use cases behind them."""
    start = F.add_months(F.lit(as_of[:10]).cast("date"), -months)
    per_case = revenue.filter(F.col("day") >= start).groupBy("category", "feature", "use_case").agg(
        F.sum(money(F.col("revenue"))).alias("_v")
    )
    return (
        per_case.groupBy("category", "feature")
        .agg(F.count("use_case").alias("use_case_count"), rounded(F.sum("_v").cast("double"), 2).alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "category", "feature")
        .limit(top)
    )


def risk_summary(items: DataFrame) -> DataFrame:
    """Items and value per status and risk.

    The names of a group are given by `risk_items`, one row each and in value
    order, since a group may hold more than fits into one cell.
    """
    return items.groupBy("status", "risk").agg(F.count(F.lit(1)).alias("item_count"), total("item_value").alias("total_value")).withColumn(
        "share_pct", percent(F.col("total_value"), items.select(total("item_value")).scalar(), 2)
    )


def risk_items(items: DataFrame, per_group: int | None = None) -> DataFrame:
    """Items of each status and risk, most valuable first; `per_group` keeps that many of each."""
    keys, order = ["status", "risk"], [F.desc_nulls_last("item_value"), F.asc("name")]
    if per_group is None:
        ranked = numbered_in_order(items, keys, order)
    else:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        ranked = items.withColumn("position", place.cast("bigint")).filter(F.col("position") <= per_group)
    return ranked.select(*keys, "position", "name", "item_value")


def open_items(deals: DataFrame, top: int | None = None) -> DataFrame:
    """Open deals, most valuable first."""
    out = deals.filter("not is_won and not is_lost").orderBy(F.desc_nulls_last("deal_value"), "deal_id")
    out = out if top is None else out.limit(top)
    return out.select("deal_id", "deal_type", "stage", "deal_value", "close_date")


def lost_items(deals: DataFrame, top: int = 20) -> DataFrame:
    """Latest lost deals."""
    return deals.filter("is_lost").orderBy(F.desc("close_date"), "deal_id").limit(top).select(
        "deal_id", "close_date", "deal_value", "competitor"
    )


def renewals(deals: DataFrame) -> DataFrame:
    """Deals with renewal value, by date."""
    return deals.filter("renewal_value > 0").orderBy("close_date", "deal_id").select("deal_id", "renewal_value", "close_date", "stage")
