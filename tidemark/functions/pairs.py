"""Pairs of items that share many groups, without listing the pairs of huge groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable


def frequent_pairs(members: DataFrame, group: str, item: str, min_groups: int, block: int = 64) -> DataFrame:
    """Unordered item pairs found together in at least `min_groups` groups.

    `members` holds distinct (group, item) rows. Three exact reductions keep hot
    groups harmless. An item in fewer than `min_groups` groups cannot be part of
    a result, so it goes first. The `min_groups - 1` widest groups are never
    expanded: a result pair must also occur in some other group, so these groups
    only add to the count of pairs already found. What is left is expanded in
    blocks of `block` items, so that one wide group spreads over many tasks.
    """
    support = members.groupBy(item).agg(F.count(F.lit(1)).alias("_s")).filter(F.col("_s") >= min_groups)
    # read six times below, so it is written out once
    kept = durable(members.join(support.select(item), item, "left_semi").select(group, item))

    widest = (
        kept.groupBy(group)
        .agg(F.count(F.lit(1)).alias("_w"))
        .filter(F.col("_w") > block)
        .orderBy(F.desc("_w"), F.col(group))
        .limit(min_groups - 1)
        .select(F.col(group).alias("_g"))
    )
    probed = F.broadcast(widest)  # at most min_groups - 1 keys
    narrow = kept.join(probed, F.col(group) == F.col("_g"), "left_anti")
    wide = kept.join(probed, F.col(group) == F.col("_g"), "left_semi")

    pairs = _expand(narrow, group, item, block)
    found = pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("_n"))

    left = wide.select(F.col(group).alias("_ga"), F.col(item).alias("item_a"))
    right = wide.select(F.col(group).alias("_gb"), F.col(item).alias("item_b"))
    extra = (
        found.select("item_a", "item_b")
        .join(left, "item_a")
        .join(right, (F.col("_ga") == F.col("_gb")) & (found["item_b"] == right["item_b"]), "left_semi")
        .groupBy("item_a", "item_b")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return (
        found.unionByName(extra)
        .groupBy("item_a", "item_b")
        .agg(F.sum("_n").cast("bigint").alias("n_groups"))
        .filter(F.col("n_groups") >= min_groups)
    )


def _expand(members: DataFrame, group: str, item: str, block: int) -> DataFrame:
    """Ordered pairs per group: small groups at once, wide ones by pairs of blocks."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_w")).filter(F.col("_w") > block)
    small = (
        members.join(sizes.select(group), group, "left_anti")
        .groupBy(group)
        .agg(F.array_sort(F.collect_list(F.struct(item, F.lit(0).alias("_i")))).alias("_m"))  # at most `block` items
        .select(F.lit(True).alias("_same"), "_m")
    )
    blocks = F.ceil(F.col("_w") / block).cast("int")
    keyed = members.join(sizes, group).withColumn("_b", blocks).withColumn("_i", F.pmod(F.xxhash64(item), F.col("_b")).cast("int"))
    # every item meets every block of its group once, in the cell of the two block numbers
    spread = keyed.select(group, item, "_i", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_j")).select(
        group, item, "_i", F.least("_i", "_j").alias("_p"), F.greatest("_i", "_j").alias("_q")
    )
    cells = (
        spread.groupBy(group, "_p", "_q")
        .agg(F.array_sort(F.collect_list(F.struct(item, "_i"))).alias("_m"))
        .select((F.col("_p") == F.col("_q")).alias("_same"), "_m")
    )
    size = F.size("_m")

    def partners(x, i):
        later = F.slice(F.col("_m"), i + 2, size)
        met = F.filter(later, lambda y: F.col("_same") | (y["_i"] != x["_i"]))
        return F.transform(met, lambda y: F.struct(x[item].alias("item_a"), y[item].alias("item_b")))

    return small.unionByName(cells).select(F.explode(F.flatten(F.transform("_m", partners))).alias("_x")).select("_x.*")
