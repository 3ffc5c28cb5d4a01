"""Shared helpers against brute force on small, skewed fixtures."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions.exact import numbered, pick_bounded, ranked_values, rounded
from tidemark.functions.pairs import frequent_pairs
from tidemark.session import shared_root


def brute_pairs(rows, least):
    groups = {}
    for g, x in rows:
        groups.setdefault(g, set()).add(x)
    n = Counter()
    for items in groups.values():
        n.update(itertools.combinations(sorted(items), 2))
    return {k: v for k, v in n.items() if v >= least}


def test_pairs_with_wide_groups(spark):
    rng = random.Random(1)
    rows = {(g, f"i{rng.randrange(60):02d}") for g in range(200) for _ in range(6)}
    # seven groups hold every item: four are only probed, three are expanded in blocks
    rows |= {(1000 + g, f"i{x:02d}") for g in range(7) for x in range(60)}
    df = spark.createDataFrame(sorted(rows), "g bigint, x string")
    got = {(r.item_a, r.item_b): r.n_groups for r in frequent_pairs(df, "g", "x", 5, block=8).collect()}
    assert got == brute_pairs(rows, 5)


def test_pairs_of_nothing(spark):
    assert frequent_pairs(spark.createDataFrame([], "g bigint, x string"), "g", "x", 2).count() == 0


def test_ranked_values_match_sorting(spark):
    rng = random.Random(2)
    data = {"hot": [round(rng.expovariate(0.02), 2) for _ in range(30000)], "one": [4.0], "same": [7.0] * 50, None: [1.0, 2.0, 3.0, 4.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    shares = {"p5": 0.05, "p50": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.k: r for r in ranked_values(df, ["k"], "v", shares).collect()}
    for k, vs in data.items():
        ordered = sorted(vs)
        for name, p in shares.items():
            assert got[k][name] == ordered[min(len(vs) - 1, int(len(vs) * p))], (k, name)


def test_numbers_are_gapless_and_ordered(spark):
    df = spark.createDataFrame([(i % 3 == 0, i % 4, i) for i in range(5000)], "k boolean, c int, id bigint")
    for key, rows in itertools.groupby(sorted(numbered(df, ["k"], ["c"], "id").collect(), key=lambda r: (r.k, r.position)), key=lambda r: r.k):
        rows = list(rows)
        assert [r.position for r in rows] == list(range(1, len(rows) + 1))
        assert [r.c for r in rows] == sorted(r.c for r in rows)


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "k int, id bigint")
    one = {tuple(r) for r in numbered(df.coalesce(1), ["k"], [], "id").collect()}
    many = {tuple(r) for r in numbered(df.repartition(13), ["k"], [], "id").collect()}
    assert one == many


def test_first_rows_per_group(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), (None, 5)], "k string, v int")
    got = sorted((r.k or "", r.v) for r in pick_bounded(df, ["k"], [F.col("v")], 2).collect())
    assert got == [("", 5), ("a", 1), ("a", 2)]


def test_rounding_of_halves(spark):
    row = spark.range(1).select(rounded(F.lit(-19.46) / F.lit(44.48) * 100, 1).alias("a"), rounded(F.lit(0.125), 2).alias("b")).first()
    assert (row.a, row.b) == (-43.8, 0.13)


def test_a_cluster_must_name_its_shared_folder():
    assert shared_root("spark://host:7077", "hdfs://store/x/") == "hdfs://store/x"
    assert shared_root("local[8]", None)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            shared_root(master, None)
