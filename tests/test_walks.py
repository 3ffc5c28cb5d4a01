"""Walks over graphs: no side through the driver, and dependents counted without a pair each."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import closure


@pytest.fixture
def plans(monkeypatch):
    """Plans of what is written during a walk."""
    seen, write = [], closure.durable

    def noted(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(closure, "durable", noted)
    return seen


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "child bigint, parent bigint")


def _sent(plans, *results):
    shown = [*plans, *(r._jdf.queryExecution().executedPlan().toString() for r in results)]
    return sum("Broadcast" in p for p in shown)


TREE = [(i, i // 2) for i in range(1, 64)]


def test_labels_send_no_side_to_the_driver(spark, plans):
    rules = spark.createDataFrame([(i,) for i in range(64) if i != 5], "node bigint")
    out = closure.resolve_dependencies(rules, _edges(spark, TREE))
    assert out.filter("not is_kept").count() == 14 and _sent(plans, out) == 0  # two trees of 7 below 5


def test_levels_send_no_side_to_the_driver(spark, plans):
    out = closure.load_order(spark.range(64).withColumnRenamed("id", "node"), _edges(spark, TREE))
    assert out.agg(F.max("level")).first()[0] == 6 and _sent(plans, out) == 0


def test_root_causes_send_no_side_to_the_driver(spark, plans):
    rows = [(1, 40, "Upstream", "2024-01-01 10:00:00"), (2, 5, "own", "2024-01-01 09:30:00"), (3, 2, "own", "2024-01-01 09:30:00")]
    failures = spark.createDataFrame(rows, "failure_id bigint, node bigint, error_message string, t string").withColumn("detected_at", F.col("t").cast("timestamp_ntz"))
    out = closure.root_cause(failures, _edges(spark, TREE), "Upstream")
    assert [tuple(r) for r in out.collect()] == [(1, 5, 3, "40>20>10>5")] and _sent(plans, out) == 0


@pytest.mark.parametrize("seed", range(4))
def test_dependents_match_a_plain_walk(spark, seed):
    r = random.Random(seed)
    pairs = [(i, i // 2) for i in range(1, 90)] + [(i, i // 3) for i in range(90) if r.random() < 0.2]
    pairs += [(r.randrange(100), r.randrange(100)) for _ in range((0, 3, 30, 0)[seed])]  # cycles, edges to itself, further roots
    pairs += [(200 + i, 200 + (i + 1) % 5) for i in range(5)] + [(300 + i, 299 + i) for i in range(1, 12)] + pairs[:5]
    states = {i: r.choice(["SUCCEEDED", "FAILED", "SKIPPED", None]) for i in range(0, 340, 2)}
    kinds = {i: r.choice(["TASK", "VIEW"]) for i in states}
    starts = [*range(0, 340, 3), 7, 7, None, 999]
    out = closure.downstream_status(
        spark.createDataFrame([(i,) for i in starts], "node bigint"), _edges(spark, pairs),
        spark.createDataFrame([(i, kinds[i], s) for i, s in states.items()], "node bigint, object_type string, state string"),
    )
    below = {}
    for c, p in pairs:
        below.setdefault(p, set()).add(c)
    want = {}
    for s in set(starts):
        met, todo = {s}, [s]
        while todo:
            new = below.get(todo.pop(), set()) - met
            met |= new
            todo += new
        bad = sum(states.get(x) == "FAILED" or (states.get(x) == "SKIPPED" and kinds[x] != "TASK") for x in met - {s})
        want[s] = (len(met) - 1, bad, "ESCALATED" if bad else "RESOLVED")
    assert {x.node: (x.dependents, x.unhealthy, x.outcome) for x in out.collect()} == want


def test_only_nodes_of_several_parents_are_walked_to(spark, monkeypatch):
    rows, walk = [], closure.reachable

    def noted(*args, **kw):
        rows.append(walk(*args, **kw))
        return rows[-1]

    monkeypatch.setattr(closure, "reachable", noted)
    pairs = [(i, i // 2) for i in range(1, 256)] + [(255, 2)]
    states = spark.createDataFrame([], "node bigint, object_type string, state string")
    out = closure.downstream_status(spark.range(256).withColumnRenamed("id", "node"), _edges(spark, pairs), states)
    assert {r.node: r.dependents for r in out.filter("node < 4").collect()} == {0: 255, 1: 254, 2: 127, 3: 126}
    assert rows[0].count() < 200  # 1,800 pairs of start and node without folding
