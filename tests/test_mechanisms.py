"""Label spreading, counters, quantiles by ranges, literal index and JSON paths: plain versions, hot groups, plans."""

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions.exact import ranked_values
from tidemark.functions.literals import fitting_pairs, required_literals
from tidemark.operators import closure, health
from tidemark.sources.runs import json_paths, nesting


def _graph(seed, n, edges):
    r = random.Random(seed)
    return sorted({(r.randrange(n), r.randrange(n + n // 6)) for _ in range(edges)})


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_spread_as_all_walks_do(spark, seed):
    pairs = _graph(seed, 120, 110)  # parents from 120 on are missing; cycles among the others
    rules = spark.createDataFrame([(i,) for i in range(120)], "node bigint")
    got = {r.node: (r.is_kept, r.missing, r.status) for r in closure.resolve_dependencies(rules, spark.createDataFrame(pairs, "child bigint, parent bigint")).collect()}
    label = {}
    for c, p in pairs:
        if p >= 120:
            label[c] = min(label.get(c, (0, p)), (0, p))
    for depth in range(1, 121):
        new = {}
        for c, p in pairs:
            if c not in label and label.get(p, (-1,))[0] == depth - 1:
                new[c] = min(new.get(c, (depth, label[p][1])), (depth, label[p][1]))
        label |= new
    want = {i: (True, None, "OK") if i not in label else (False, label[i][1], "DEPENDS_ON_DROPPED" if label[i][0] else "MISSING_DEPENDENCY") for i in range(120)}
    assert got == want and len({s for _, _, s in want.values()}) == 3


def test_one_label_a_node_below_a_hub(spark):
    # 300 broken rules below one hub that 300 rules need: 601 labels, where pairs of start and node were 90,600
    pairs = [(i, 10_000 + i) for i in range(300)] + [(500, i) for i in range(300)] + [(600 + i, 500) for i in range(300)]
    edges = spark.createDataFrame(pairs, "child bigint, parent bigint")
    up = edges.where("parent < 10000").select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    labels = closure.spread_labels(up, edges.where("parent >= 10000").select(F.col("child").alias("node"), F.col("parent").alias("label")))
    rows = labels.collect()
    assert Counter(r.depth for r in rows) == {0: 300, 1: 1, 2: 300} and {r.label for r in rows if r.depth} == {10_000}


def test_labels_of_an_empty_graph(spark):
    none = spark.createDataFrame([], "child bigint, parent bigint")
    assert [tuple(r) for r in closure.resolve_dependencies(spark.createDataFrame([(1,)], "node bigint"), none).collect()] == [(1, True, None, "OK")]


@pytest.mark.parametrize("seed", [3, 4])
def test_levels_match_a_plain_walk(spark, seed):
    r = random.Random(seed)
    pairs = sorted({(a, b) for a, b in ((r.randrange(150), r.randrange(180)) for _ in range(260)) if a > b or r.random() < 0.02})
    pairs += pairs[:5]  # repeated edges count once
    got = {x.node: x.level for x in closure.load_order(spark.createDataFrame([(i,) for i in range(150)], "node bigint"), spark.createDataFrame(pairs, "child bigint, parent bigint")).collect()}
    needs = {i: {p for c, p in pairs if c == i and p < 150} for i in range(150)}
    level = {}
    while True:
        new = {i: max((level[p] for p in needs[i]), default=-1) + 1 for i in needs if i not in level and needs[i] <= level.keys()}
        if not new:
            break
        level |= new
    assert got == {i: level.get(i) for i in range(150)} and max(level.values()) > 3


def test_quantiles_of_one_large_group(spark):
    r = random.Random(5)
    values = [r.lognormvariate(0, 6) for _ in range(20000)] + [1e300, -1e300, 5e-324, 0.0, -0.0, math.inf, math.inf, -math.inf] + [7.25] * 9000
    shares = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99, "top": 1.0}
    df = spark.createDataFrame([("all", v) for v in values] + [("all", None), (None, 3.0)], "k string, v double").repartition(6)
    ordered = sorted(values)
    for small, buckets in ((4096, 1024), (1, 2), (100, 16)):
        if buckets == 2:
            shares, df_now = {"p50": 0.5}, df.where("abs(v) < 1000")
            now = sorted(v for v in values if abs(v) < 1000)
        else:
            df_now, now = df, ordered
        got = {x.k: x for x in ranked_values(df_now, ["k"], "v", shares, small, buckets).collect()}
        for name, p in shares.items():
            assert got["all"][name] == now[min(len(now) - 1, int(len(now) * p))], (name, small)
            assert got[None][name] == 3.0
        shares = {"p1": 0.01, "p50": 0.5, "p99": 0.99}


def test_quantiles_sort_no_group_by_a_window(spark):
    df = spark.range(50_000).select(F.lit("all").alias("k"), (F.col("id") * 7919 % 50_000).cast("double").alias("v"))
    out = ranked_values(df, ["k"], "v", {"p50": 0.5})
    assert out.first().p50 == 25_000.0
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()  # what is left to sort is one small range


def test_quantiles_of_decimals_and_nothing(spark):
    df = spark.sql("SELECT 'a' AS k, CAST(id AS DECIMAL(38,10)) / 3 AS v FROM range(9000)")
    assert ranked_values(df, ["k"], "v", {"p50": 0.5}, small=10).first().p50 == sorted(r.v for r in df.collect())[4500]
    assert ranked_values(df.limit(0), ["k"], "v", {"p50": 0.5}).count() == 0


PATTERNS = ["timeout after \\d+ seconds", "Numeric value .* is not", "colou?rs here", "a|b", "(abc|def)ghi", "(?i)ERROR code", "x{3}yz", "^start.end$", "[abc]+tail", "a.b", "", "\\Qa.b\\E", "lit\\.eral", "((nested) group) after", "ab+cde", "(((((deep)))))", "é{2}clair", "[]x]yzw", "plain words"]


def test_literals_are_in_every_match(spark):
    rows = spark.createDataFrame([(p,) for p in PATTERNS], "p string").select("p", required_literals(F.col("p")).alias("l")).collect()
    found = {r.p: r.l for r in rows}
    assert found["timeout after \\d+ seconds"] == ["timeout after ", " seconds"] and found["Numeric value .* is not"] == ["Numeric value ", " is not"]
    assert found["colou?rs here"] == ["colo", "rs here"] and found["a|b"] == found["(?i)ERROR code"] == found["a.b"] == found[""] == found["(((((deep)))))"] == []
    assert found["(abc|def)ghi"] == ["ghi"] and found["lit\\.eral"] == ["lit", "eral"] and found["ab+cde"] == ["cde"] and found["^start.end$"] == ["start", "end"]


def test_index_finds_the_pairs_of_all_comparisons(spark):
    r = random.Random(8)
    texts = [r.choice(["timeout after 12 seconds", "Numeric value 'x' is not", "colors here", "colours here", "b", "defghi abc", "error CODE", "xxxyz", "start-end", "abctail", "a-b", "lit.eral", "group after nested group after", "abbbcde", "deep", "ééclair", "plain words", "line\nbreak plain words"]) + r.choice(["", " and more", "!"]) for _ in range(300)] + [""]
    df, rules = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string"), spark.createDataFrame([(p,) for p in PATTERNS] + [(None,)], "p string")
    pairs = fitting_pairs(df, "t", rules, "p", required_literals(F.col("p")), F.expr("t rlike p"))
    want = {(r.t, r.p) for r in df.distinct().crossJoin(rules).where("t rlike p").collect()}
    got = [(r.t, r.p) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want) > 40


def test_no_nested_loop_for_many_patterns(spark):
    runbook = spark.range(10_000).selectExpr("concat('failure number ', id, ' of unit') AS error_pattern", "'c' AS error_category", "'fix {OBJECT}' AS fix_template", "id / 10000 AS confidence", "'ALL' AS object_type")
    failures = spark.range(2_000).selectExpr("id AS failure_id", "concat('JOB_', id) AS object_name", "'TASK' AS object_type", "concat('saw failure number ', id * 7 % 20000, ' of unit') AS error_message")
    out = health.match_runbook(failures, runbook)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = out.collect()
    assert len(rows) == 2000
    for x in rows:
        n = x.failure_id * 7 % 20000
        assert x.error_pattern == (f"failure number {n} of unit" if n < 10_000 else None)


def _paths(value, path, out):
    children = value.items() if isinstance(value, dict) else ((None, x) for x in value) if isinstance(value, list) else ()
    for key, x in children:
        own = f"{path}.{key}" if key is not None else f"{path}[]"
        kind = {dict: "OBJECT", list: "ARRAY", str: "STRING", bool: "BOOLEAN", type(None): "VOID"}.get(type(x), "BIGINT")
        out[own, kind, own.count(".") + own.count("[]")] += 1
        _paths(x, own, out)


def test_json_paths_of_odd_values(spark):
    r = random.Random(1)

    def value(depth):
        kind = r.random()
        if depth == 0 or kind < 0.4:
            return r.choice([1, True, None, 'a "b" {[\\', "x", -5])
        return {r.choice("abc"): value(depth - 1) for _ in range(r.randint(0, 3))} if kind < 0.75 else [value(depth - 1) for _ in range(r.randint(0, 3))]

    values = [value(6) for _ in range(300)] + [{}, [], 3, {"a": {"a": [[[[{"b": 1}]]]]}}]
    texts = [json.dumps(v) for v in values] + [None, "", "{broken", "[1,"]
    want = Counter()
    for v in values:
        _paths(v, "", want)
    df = spark.createDataFrame([(t,) for t in texts], "body string").repartition(3)
    out = json_paths(df, "body")
    assert {(x.path, x.value_type, x.depth): x.occurrences for x in out.collect()} == want
    assert {(x.path, x.value_type, x.depth): x.occurrences for x in json_paths(df, "body", max_depth=2).collect()} == {k: n for k, n in want.items() if k[2] <= 2}
    assert json_paths(df.limit(0), "body").count() == 0
    depths = [x[0] for x in df.select(nesting(F.col("body"))).where("body IS NOT NULL").collect()]
    assert max(depths) >= max(k[2] for k in want) and not re.search("Checkpoint|Scan ExistingRDD.*value", out._jdf.queryExecution().optimizedPlan().toString())


def test_index_answers_as_the_plain_search(spark, tmp_path):
    from tidemark.operators.retrieval import build_index, search, search_many

    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(["the"] * r.randint(1, 4) + r.choices(words, [1 / (i + 1) for i in range(300)], k=r.randint(0, 60))) for _ in range(400)] + ["", None, "the " * 500, texts_twice := "w1 w2 rare", texts_twice]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    asked = {1: "the w5 W5, w250", 2: "the", 3: "rare", 4: "unknown words only", 5: "", 6: " ".join(words[:40]), 7: None, 8: "w299 the w0 w1"}
    index = build_index(docs, "id", "text", str(tmp_path / "index"))
    for k in (3, 10):
        got = {}
        for x in search_many(index, spark.createDataFrame(list(asked.items()), "q long, text string"), "q", "text", k).collect():
            got.setdefault(x.q, set()).add((x.id, x.score))
        want = {q: {(x.id, x.score) for x in search(docs, "id", "text", t, k).collect()} for q, t in asked.items() if t and t not in ("unknown words only",)}
        assert got == {q: v for q, v in want.items() if v}
    empty = build_index(docs.limit(0), "id", "text", str(tmp_path / "none"))
    assert search_many(empty, spark.createDataFrame([(1, "the")], "q long, text string"), "q", "text").count() == 0
