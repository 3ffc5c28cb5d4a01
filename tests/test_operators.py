"""Rule tables from both sides of each threshold, pinned corner cases, and invariants."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.naming import column_class, column_role, describe_column
from tidemark.functions.sqltext import column_references, extract_tables, is_write, normalize_table, strip_comments
from tidemark.operators import catalog as K
from tidemark.operators import closure as C
from tidemark.operators import drift as D
from tidemark.operators import evals as E
from tidemark.operators import health as H
from tidemark.operators import relations as R
from tidemark.operators import reviews as V
from tidemark.operators import rules as L
from tidemark.operators import timing as T
from tidemark.operators import trends as B
from tidemark.operators import watch as W
from tidemark.sources import query_files as S


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.v for r in df.select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


def test_comments_are_removed_in_order_even_in_literals(spark):
    got = values(spark, ["a -- b\nc", "a /* x\ny */ b", "see 'http://x' y", "/* -- */ z"], strip_comments)
    assert got == ["a \nc", "a  b", "see 'http:", "/* "]


def test_writes(spark):
    sql = ["select 1", " insert into t select 1", "create or replace temp table x as select 1", "-- drop\nselect 1", "with a as (select 1)\ndelete from t", "create view v as select 1"]
    assert values(spark, sql, is_write) == [False, True, True, False, True, False]


def test_names(spark):
    assert values(spark, ['"db".."t"', "a.b.c", "a..b..c"], normalize_table) == ["DB.PUBLIC.T", "A.B.C", "A..B..C"]


def test_tables_and_columns(spark):
    sql = ["select * from a.b.c x join PAY1 join PAYMENT p on x.ID = p.id, lateral (select 1) join 123", "select t.ps_prd_x, t.public, t.col from t"]
    assert values(spark, sql, extract_tables) == [["A.B.C", "PAYMENT"], ["T"]]
    assert [[(p.alias, p.name) for p in v] for v in values(spark, sql, column_references)][1] == [("T", "COL")]


def test_names_of_columns(spark):
    assert values(spark, ["CUSTOMER_ID", "ORDER_DATE", "TOTAL_X", "IS_NEW", "STATUS", "NAME", "OTHER"], column_role) == [
        "foreign_key", "dimension", "metric", "dimension", "dimension", "dimension", "attribute",
    ]
    # a type with INT inside counts as numeric, and a date type comes first
    kinds = values(spark, ["POINT", "TIMESTAMP", "VARCHAR"], lambda t: column_class(F.lit("X"), t))
    assert kinds == ["fact", "time_dimension", "dimension"]
    assert values(spark, ["LONG_DESCRIPTION", "LONG_DESC", "ROW_COUNT", "COUNT", "ACCT_ID"], describe_column) == [
        "Long description", "Long description", "Count of row", "Record count", "Account identifier - join to dim_acct",
    ]


def catalog(spark, tables):
    rows = [(db, sc, t, c, "NUMBER", i + 1, True, None) for (db, sc, t), cols in tables.items() for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "database_name string, schema_name string, table_name string, column_name string, data_type string, ordinal bigint, nullable boolean, comment string")


def test_inferred_relations_prefer_the_same_schema(spark):
    c = catalog(
        spark,
        {
            ("D", "S1", "ORDERS"): ["ID", "CUSTOMER_ID", "BUS_ID"], ("D", "S2", "CUSTOMER"): ["ID"], ("D", "S1", "CUSTOMERS"): ["KEY"],
            ("A", "Z", "CUSTOMER"): ["ID"], ("D", "S1", "BU"): ["ID", "BU_ID"],
        },
    )
    got = {(r.source_table, r.source_column): (r.target_table, r.target_has_column) for r in R.relations_inferred(c).collect()}
    assert got == {("D.S1.ORDERS", "CUSTOMER_ID"): ("A.Z.CUSTOMER", True), ("D.S1.ORDERS", "BUS_ID"): ("D.S1.BU", True)}


def test_delta_after_delta_changes_nothing(spark):
    old = K.hashed(catalog(spark, {("D", "S", "A"): ["X"], ("D", "S", "B"): ["Y"]}))
    new = K.hashed(catalog(spark, {("D", "S", "A"): ["X", "Z"], ("D", "S", "C"): ["Y"]}))
    once = K.delta_upsert(old, new)
    assert sorted((r.table_name, r.action) for r in once.collect()) == [("A", "update"), ("B", "keep"), ("C", "insert")]
    assert {r.action for r in K.delta_upsert(once, new).collect()} == {"keep"}


def test_watch_says_so_when_nothing_is_there(spark):
    concepts = spark.createDataFrame([], "full_name string, quality_score double, enriched_at timestamp_ntz, is_active boolean")
    tables = spark.createDataFrame([], "database_name string, schema_name string, table_name string, last_altered timestamp_ntz")
    access = spark.createDataFrame([], "query_id bigint, user_name string, ts timestamp_ntz, objects array<struct<object_name:string,object_domain:string>>")
    rows = W.watch_states(concepts, tables, access, "2024-01-01 00:00:00").collect()
    assert [(r.object_fqn, r.object_state) for r in rows] == [("", "KNOWN_CURRENT")]


def brute_reach(edges, start):
    seen, front, depth = {start: 0}, [start], 0
    while front:
        depth += 1
        front = sorted({d for s, d in edges if s in front} - set(seen))
        seen.update({n: depth for n in front})
    return seen


def test_closure_ends_on_cycles(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (1, 4), (9, 1)]
    walk = C.reachable(spark.createDataFrame(edges, "src bigint, dst bigint"), spark.createDataFrame([(1,), (9,)], "node bigint"))
    got = {}
    for r in walk.collect():
        got.setdefault(r.start, {})[r.node] = r.depth
    assert got == {s: brute_reach(edges, s) for s in (1, 9)}


def test_rules_on_a_cycle_have_no_level(spark):
    rules = spark.createDataFrame([(i,) for i in range(1, 6)], "node bigint")
    depends = spark.createDataFrame([(2, 1), (3, 2), (4, 5), (5, 4)], "child bigint, parent bigint")
    assert {r.node: r.level for r in C.load_order(rules, depends).collect()} == {1: 0, 2: 1, 3: 2, 4: None, 5: None}


def test_missing_dependency_drops_the_dependents(spark):
    rules = spark.createDataFrame([(1,), (2,), (3,)], "node bigint")
    depends = spark.createDataFrame([(2, 99), (3, 2)], "child bigint, parent bigint")
    got = {r.node: (r.is_kept, r.status) for r in C.resolve_dependencies(rules, depends).collect()}
    assert got == {1: (True, "OK"), 2: (False, "MISSING_DEPENDENCY"), 3: (False, "DEPENDS_ON_DROPPED")}


def test_guardrail(spark):
    rows = [
        ("drop table x", 1.0, 0.9), ("alter table x add y int", 0.9, 0.9), ("alter table x add y int", 0.9, None), ("select 1", 0.9, None), ("select 1", 0.79, None),
        ("select 'NEEDS_FIX'", 0.9, None), ("call p()", 0.9, None), ("call p()", None, None), ("alter task t resume", 0.8, None), ("alter task t modify as select 1", 0.9, 0.79),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, fix string, confidence double, runbook_confidence double")
    assert [r.guardrail for r in H.guardrail(df).orderBy("i").collect()] == [
        "BLOCK:BLOCKED_OPERATION", "PASS", "REVIEW:BLOCKED_OPERATION", "PASS", "REVIEW:LOW_CONFIDENCE", "REVIEW:NEEDS_DIAGNOSIS", "REVIEW:UNKNOWN_OPERATION",
        "REVIEW:LOW_CONFIDENCE", "PASS", "REVIEW:BLOCKED_OPERATION",
    ]


def test_paired_t_without_spread(spark):
    a = spark.createDataFrame([(m, r, 0.5 + d) for m, d in (("up", 0.1), ("same", 0.0), ("down", -0.1)) for r in (1, 2, 3)], "metric string, run bigint, mean_score double")
    b = spark.createDataFrame([(m, r, 0.5) for m in ("up", "same", "down") for r in (1, 2, 3)], "metric string, run bigint, mean_score double")
    got = {r.metric: (r.t_value, r.decision) for r in E.paired_t(a, b).collect()}
    assert got == {"up": (float("inf"), "ACCEPT"), "same": (0.0, "ACCEPT"), "down": (float("-inf"), "REJECT")}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40, 101])
def test_split_sizes(spark, n):
    df = spark.createDataFrame([(i, "a") for i in range(n)], "test_id bigint, test_category string")
    dev = E.stratified_split(df).filter("split = 'DEV'").count()
    assert dev == int(n * 0.45 + 0.5)


def test_alert_edges(spark):
    rows = [("rule-reviewer", "FULL", d) for d in (59.9, 60.0, 119.9, 120.0, 600.0, 600.1)] + [("rule-creator", "ANY", 89.0), ("other", "FULL", 1.0)]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "run_id string, skill_name string, mode string, duration_seconds double")
    assert {r.run_id: r.alert_type for r in T.alerts(df).collect()} == {
        "0": "error_short_duration", "1": "warning_short_duration", "2": "warning_short_duration", "5": "warning_long_duration", "6": "error_short_duration",
    }


def test_fiscal_year(spark):
    days = ["2026-01-31", "2026-02-01", "2025-12-31"]
    assert values(spark, days, lambda x: B.fiscal_year(F.to_date(x))) == [2026, 2027, 2026]
    assert B.fiscal_ranges("2026-02-10")["look_back"] == ("2025-02-01", "2026-01-31")
    assert B.fiscal_ranges("2026-01-10")["look_back"] == ("2024-02-01", "2025-01-31")


def test_growth_from_zero_is_unknown(spark):
    df = spark.createDataFrame([("2024-01-05", 0.0), ("2024-02-05", 5.0)], "d string, revenue double").select(F.to_date("d").alias("day"), "revenue")
    assert [r.growth_pct for r in B.monthly_growth(df, "2024-03-01").orderBy("month").collect()] == [None, None]


def test_size_bands(spark):
    sizes = [400, 401, 450, 500, 501, 600, 650, 700, 750, 800, 900, 901]
    df = spark.createDataFrame([(n, "\n".join(["x"] * n)) for n in sizes], "doc_id bigint, text string")
    got = {r.doc_id: r.size_score for r in V.size_score(df).collect()}
    assert [got[n] for n in sizes] == [10, 9, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0]


def test_points_of_a_perfect_review(spark):
    for weights, total in ((V.RULE_WEIGHTS, 115.0), (V.PLAN_WEIGHTS, 100.0), (V.DOC_WEIGHTS, 100.0)):
        df = spark.createDataFrame([tuple([10] * len(weights))], ", ".join(f"{w} int" for w in weights))
        assert V.weighted_score(df, weights).first().total_points == total


def test_budget(spark):
    def decide(rows):
        df = spark.createDataFrame([(1, *r) for r in rows], "request_id int, rule string, tokens bigint, tier string, is_related boolean")
        return {r.rule: (r.decision, r.budget) for r in L.budget_select(df).collect()}

    worked = [("core", 3500, "critical", True), ("py", 1800, "high", True), ("test", 3500, "medium", True), ("a", 1800, "high", True), ("b", 3700, "high", True)]
    assert set(decide(worked).values()) == {("LOAD", "OK")}
    over = decide([("core", 19000, "critical", True), ("h", 900, "high", True), ("m", 900, "medium", False), ("l", 10, "low", True), ("r", 50, "medium", True)])
    assert {k: v[0] for k, v in over.items()} == {"core": "LOAD", "r": "LOAD", "h": "LOAD", "m": "DEFER", "l": "DEFER"}


def test_first_baseline_finds_no_drift(spark):
    c = catalog(spark, {("D", "S", "A"): ["X"]})
    assert D.baseline_drift(None, c).count() == 0
    assert {r.change for r in D.baseline_drift(c, catalog(spark, {("D", "S", "A"): ["Y"]})).collect()} == {"NEW", "REMOVED"}


def test_folder_of_mixed_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text('SQL,Question\n"select 1\nfrom t",one\n,two\nselect 2,"a ""b"""\n')
    (tmp_path / "sub" / "b.json").write_text(json.dumps(["select 3", {"sql": "select 4", "Domain": "x"}, {"other": 1}, 5]))
    (tmp_path / "sub" / "c.json").write_text('{"sql": "no array"}')
    (tmp_path / "bad.json").write_text("{broken")
    (tmp_path / "d.sql").write_text("select 5\n-- end")
    rows = S.read_query_path(spark, str(tmp_path)).orderBy("index").collect()
    assert [(r["index"], r.kind, r.sql) for r in rows] == [
        (1, "csv", "select 1\nfrom t"), (2, "csv", "select 2"), (3, "json", "select 3"), (4, "json", "select 4"), (5, "sql", "select 5\n-- end"),
    ]
    assert rows[1].metadata == {"Question": 'a "b"'} and rows[3].metadata == {"Domain": "x"}
    with pytest.raises(ValueError):
        S.read_query_path(spark, str(tmp_path / "x.txt"))


def shingles(text, size=3):
    words = " ".join(text.lower().split()).split(" ")
    return {" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))}


def test_near_duplicates_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(25)]
    # one text with many near copies, and each of the others with one or none
    docs = list(texts)
    for i in range(60):
        words = texts[0].split()
        words[rng.randrange(40)] = f"x{i % 7}"
        docs.append(" ".join(words))
    for t in texts[1:12]:
        docs.append(t.replace("w1 ", "w2 ", 1))
    docs += [texts[3], "  " + texts[4].upper(), "short", "short text"]
    sets = [shingles(d) for d in docs]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    newest = {}
    for i, d in enumerate(docs):
        newest[" ".join(d.lower().split())] = i
    distinct = set(newest.values())

    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    found = {r.doc_id: r.keeper for r in V.near_duplicates(df, reps=2).collect()}
    assert found and set(found) <= distinct
    assert all(k > d and alike(d, k) for d, k in found.items())
    kept = sorted(distinct - set(found))
    assert not [(a, b) for a in kept for b in kept if a < b and alike(a, b)]
