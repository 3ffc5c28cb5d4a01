"""Aggregation helpers whose results do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import durable


def money(value: Column) -> Column:
    """Exact decimal form, so that sums do not depend on the order of rows."""
    return value.cast("decimal(20,4)")


def rounded(value: Column, digits: int = 0) -> Column:
    """Half-up rounding that floating-point noise below ten decimals does not sway."""
    return F.round(F.round(value, 10), digits)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent; null when the whole is zero."""
    return rounded(F.try_divide(part * F.lit(100.0), whole.cast("double")), digits)


def one_row(df: DataFrame) -> Column:
    """Row of a one-row aggregate as a struct, computed once for the whole query."""
    return df.select(F.struct(*df.columns).alias("r")).scalar()


def text_list(values: Column, separator: str = ",") -> Column:
    """Distinct values of a bounded set as one sorted text."""
    return F.array_join(F.array_sort(F.collect_set(values)), separator)


def head(items: Column, n: int | None) -> Column:
    """First n elements of an array; None keeps all."""
    return items if n is None else F.slice(items, 1, n)


def pick_bounded(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per key group; Spark prunes to n rows per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)


def ranked_values(
    df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float], small: int = 4096, buckets: int = 1024
) -> DataFrame:
    """Exact order statistics per group, without sorting a group or shuffling its values.

    `shares` maps an output name to p: the value at 0-based rank floor(n * p), never past the last row. Each rank has a
    range of values, at first the whole group's. Tasks count the rows of a range per equal part of it; the part that holds
    the rank is the next range, with its least and greatest value as ends. A range of one value is the answer, one of
    `small` rows at most is sorted. So a round shuffles counts only, whatever the group's size, and each scan of the rows
    keeps those inside open ranges. Ranges are written out each round, so that a task that runs again sees the same ones.
    Nulls do not count; NaN is the greatest value.
    """
    keys, by = list(keys), [*keys, "what"]
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    groups = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    ranks = [F.struct(F.lit(name).alias("what"), F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1).alias("rank")) for name, p in shares.items()]
    open_ = durable(groups.select(*keys, "n", "lo", "hi", F.explode(F.array(*ranks)).alias("_r")).select(*keys, "n", "lo", "hi", "_r.*"))
    wide = (F.col("lo") != F.col("hi")) & (F.col("n") > small)

    def inside(ranges: DataFrame) -> DataFrame:
        return null_safe_join(known, ranges, keys).filter((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))

    low, high, v = (F.col(c).cast("double") for c in ("lo", "hi", "_v"))
    unbounded = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    part = (
        F.when(unbounded(high), (F.col("_v") == F.col("hi")).cast("int"))
        .when(unbounded(low), (F.col("_v") != F.col("lo")).cast("int"))
        .when(high <= low, (F.col("_v") > F.col("lo")).cast("int"))  # different values that are one double
        .otherwise(F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * buckets).cast("int"))
    )
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_part"))  # at most `buckets` + 1 rows a range
    while not open_.filter(wide).isEmpty():
        counts = inside(open_.filter(wide)).groupBy(*by, "rank", part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        held = counts.withColumn("_upto", upto).filter((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_c")))
        narrowed = held.select(*keys, F.col("_c").alias("n"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "what", (F.col("rank") - F.col("_upto") + F.col("_c")).alias("rank"))
        open_ = durable(narrowed.unionByName(open_.filter(~wide)))
    several = inside(open_.filter("lo <> hi")).groupBy(*by, "rank").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    hit = several.select(*by, F.get("_all", F.col("rank").cast("int")).alias("_v")).unionByName(open_.filter("lo = hi").select(*by, F.col("lo").alias("_v")))
    return hit.groupBy(*keys).agg(*[F.max(F.when(F.col("what") == name, F.col("_v"))).alias(name) for name in shares])


def numbered(df: DataFrame, keys: Sequence[str], coarse: Sequence[str], unique: str, name: str = "position") -> DataFrame:
    """Row numbers per key group, from 1, without putting a group into one task.

    Rows are ordered by the `coarse` columns (few distinct values), then by the
    hash of the unique column. Rows are counted per coarse value and hash range;
    the running sum of these counts gives each range its first number, and only
    the rows of one range are sorted together.
    """
    by = [*keys, *coarse, "_b"]
    hashed = df.withColumn("_h", F.md5(F.col(unique).cast("string"))).withColumn("_b", F.substring("_h", 1, 3))
    counts = hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy(*coarse, "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy(*by).orderBy("_h", F.col(unique))
    return (
        null_safe_join(hashed, starts, by)
        .withColumn(name, (F.row_number().over(within) + F.col("_o")).cast("bigint"))
        .drop("_h", "_b", "_o")
    )


def numbered_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """Row numbers per key group, from 1, in a total order, without sorting a group in one task.

    Rows are dealt by ranges of keys and order, so a hot group spreads over many ranges. The ranges are written out, so
    that a task that runs again sees the same ones; counts per group and range give each range its first number.
    """
    dealt = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_b", F.spark_partition_id())
    dealt = durable(dealt)
    by = [*keys, "_b"]
    counts = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = counts.select(*by, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy(*by).orderBy(*order)
    return null_safe_join(dealt, starts, by).withColumn(name, (F.row_number().over(within) + F.col("_o")).cast("bigint")).drop("_b", "_o")


def merged_spans(spans: DataFrame, start: str, end: str) -> DataFrame:
    """Closed time spans without overlaps, cut at full hours: slot, start and end.

    Spans of one hour that begin together are one row before the shuffle, so many whole hours cost one row each. Within
    an hour a span opens a new group where it begins after the latest end so far. Spans without a begin or an end, or
    that end before they begin, hold nothing.
    """
    hour = F.expr("INTERVAL 1 HOUR")
    known = spans.filter(F.col(start) <= F.col(end)).select(F.col(start).alias("_s"), F.col(end).alias("_e"))
    slots = F.explode(F.sequence(F.date_trunc("HOUR", "_s"), F.date_trunc("HOUR", "_e"), hour))
    cut = known.select("_s", "_e", slots.alias("slot")).select(
        "slot", F.greatest("_s", "slot").alias("_s"), F.least(F.col("_e"), F.col("slot") + hour).alias("_e")
    )
    distinct = cut.groupBy("slot", "_s").agg(F.max("_e").alias("_e"))
    ordered = Window.partitionBy("slot").orderBy("_s")
    upto = F.max("_e").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = distinct.withColumn("_new", F.coalesce((F.col("_s") > upto).cast("int"), F.lit(1)))
    return opened.withColumn("_g", F.sum("_new").over(ordered)).groupBy("slot", "_g").agg(F.min("_s").alias(start), F.max("_e").alias(end)).drop("_g")


def as_large(df: DataFrame) -> DataFrame:
    """Join side that grows with the input: both sides are shuffled and merged.

    Spark estimates a relation from its file and leaves out what an explode or a well compressed text adds; by that
    estimate it would send millions of rows through the driver. Wide keys are still split by adaptive execution.
    """
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, limit: int = 5000) -> DataFrame:
    """Broadcast a rule table after counting it; a larger one joins as Spark decides."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys that may hold nulls, keeping the left copy of each key."""
    renamed = right.withColumnsRenamed({key: f"_r_{key}" for key in keys})
    cond = None
    for key in keys:
        term = F.col(f"_l.{key}").eqNullSafe(F.col(f"_r_{key}"))
        cond = term if cond is None else cond & term
    return left.alias("_l").join(renamed, cond, how).drop(*[f"_r_{key}" for key in keys])
