"""Totals of all subtrees of a forest by parallel tree contraction, in rounds of joins.

A round rakes all leaves (their sums go to the parents) and compresses chains: of two nodes in a row with one child each,
the upper one is spliced out and its sum travels with the edge of the lower one. Whole chains halve per round, so a chain
of n nodes is gone after about log2(n) rounds. Re-expansion walks the rounds back: a spliced node's total is that of its
child plus what both held when it went.

Each round groups rows by node twice. Sums are formed before the shuffle, so a node with very many children is one row a
task, and nothing is joined by parent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def subtree_totals(tree: DataFrame, values: Sequence[str], level: str = "depth") -> DataFrame:
    """id and, for each of `values`, its sum over the subtree of each node (itself included).

    tree: id (long, distinct), parent (long, null for a root), `level` (long: larger than the parent's; it tells
    neighbours of a chain apart), and value columns (long; null counts as 0). Other columns are ignored. An empty table
    gives an empty result. A row whose parent is not there adds to nothing that is returned.
    """
    have, carry = [f"_have_{v}" for v in values], [f"_carry_{v}" for v in values]  # of the node; of spliced nodes on its edge
    one = F.lit(1).cast("long")
    kids = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    state = tree.select("id", "parent", F.col(level).cast("long").alias("level"), *[F.coalesce(F.col(v).cast("long"), F.lit(0)).alias(h) for v, h in zip(values, have, strict=True)], *[F.lit(0).cast("long").alias(c) for c in carry])
    state = stored(state.join(kids, "id", "left").withColumns({"kids": F.coalesce("kids", F.lit(0)), "child": F.lit(None).cast("long")}))
    bits = max(1, int(state.agg(F.max("level")).first()[0] or 0).bit_length())
    rounds = []
    while True:
        alive = state.where("child IS NULL")
        rounds.append(state)
        if alive.where("kids > 0").isEmpty():
            break
        bit, turned = len(rounds) % bits, len(rounds) // bits % 2
        none, leaf = F.lit(None).cast("long"), F.col("kids") == 0
        own = alive.where(~leaf).select("id", "parent", "level", *have, *carry, F.lit(0).cast("long").alias("kids"), none.alias("only"), none.alias("only_level"), *[F.lit(0).cast("long").alias(f"{c}_only") for c in carry])
        below = alive.where("parent IS NOT NULL").select(
            F.col("parent").alias("id"), none.alias("parent"), none.alias("level"),
            *[F.when(leaf, F.col(h) + F.col(c)).otherwise(0).alias(h) for h, c in zip(have, carry, strict=True)], *[F.lit(0).cast("long").alias(c) for c in carry],
            F.when(leaf, 0).otherwise(one).alias("kids"), F.when(~leaf, F.col("id")).alias("only"), F.when(~leaf, F.col("level")).alias("only_level"), *[F.when(leaf, 0).otherwise(F.col(c)).alias(f"{c}_only") for c in carry],
        )
        sums = [*have, *carry, "kids", *[f"{c}_only" for c in carry]]
        raked = own.unionByName(below).groupBy("id").agg(*[F.max(c).alias(c) for c in ("parent", "level", "only", "only_level")], *[F.sum(c).alias(c) for c in sums])
        # a row without a level is a parent that the table lacks
        raked = raked.where("level IS NOT NULL")

        def marked(column):
            return F.shiftright(column, bit).bitwiseAND(F.lit(1)) != turned

        goes = (F.col("kids") == 1) & F.col("parent").isNotNull() & marked("level") & ~marked("only_level")
        spliced = raked.where(goes)
        stays = raked.where(~goes).select("id", "parent", none.alias("new_parent"), "level", *have, *carry, "kids")
        moved = spliced.select(F.col("only").alias("id"), none.alias("parent"), F.col("parent").alias("new_parent"), none.alias("level"), *[F.lit(0).cast("long").alias(h) for h in have], *[(F.col(h) + F.col(c)).alias(c) for h, c in zip(have, carry, strict=True)], F.lit(0).cast("long").alias("kids"))
        after = stays.unionByName(moved).groupBy("id").agg(F.coalesce(F.max("new_parent"), F.max("parent")).alias("parent"), F.max("level").alias("level"), *[F.sum(c).alias(c) for c in (*have, *carry, "kids")])
        gone = spliced.select("id", "parent", "level", *[(F.col(h) + F.col(f"{c}_only")).alias(h) for h, c in zip(have, carry, strict=True)], *[F.lit(0).cast("long").alias(c) for c in carry], "kids", F.col("only").alias("child"))
        state = stored(after.withColumn("child", none).unionByName(gone))

    def raked_in(state: DataFrame) -> DataFrame:
        return state.where("child IS NULL AND kids = 0").select("id", *have)

    totals = raked_in(rounds[-1])
    for later, state in zip(reversed(rounds), reversed(rounds[:-1]), strict=False):
        gone = later.where("child IS NOT NULL")
        if not gone.isEmpty():
            known = totals.select(F.col("id").alias("child"), *[F.col(h).alias(c) for h, c in zip(have, carry, strict=True)])
            totals = totals.union(stored(gone.drop(*carry).join(known, "child").select("id", *[(F.col(h) + F.col(c)).alias(h) for h, c in zip(have, carry, strict=True)])))
        totals = totals.union(raked_in(state))
    return totals.toDF("id", *values)
