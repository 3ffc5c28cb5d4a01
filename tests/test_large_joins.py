"""Joins of relations that grow with the catalog go through a shuffle, not through the driver."""

import pytest

from tidemark.operators import drift
from tidemark.plans import load_all


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.range(1, 121).selectExpr(
        "id as p_partkey", "concat('part ', id) as p_name", "concat('Brand#', id % 5) as p_brand", "if(id % 6 = 0, 'LARGE', 'PROMO') as p_type",
        "cast(id % 50 + 1 as int) as p_size", "cast(id as double) as p_retailprice",
    ).write.parquet(f"{folder}/part.parquet")
    spark.range(1, 41).selectExpr(
        "id as o_orderkey", "id % 7 as o_custkey", "'F' as o_orderstatus", "cast(id as double) as o_totalprice", "timestamp_ntz '2001-07-01 00:00:00' as o_orderdate", "'1' as o_orderpriority",
    ).write.parquet(f"{folder}/orders.parquet")
    return folder


def sent(df) -> list[str]:
    """Joins of the plan that send a side through the driver, but for look-ups of a bounded size by range of numbers."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "_r__b" not in x]


@pytest.mark.parametrize("name", ["score_new_column", "drift_manifest", "apply_approvals", "artifact_audit", "validate_contract"])
def test_no_catalog_side_is_broadcast(spark, small, name):
    assert sent(load_all()[name].run(spark, small)) == []


def test_approvals_keep_their_rows(spark):
    rows = [(1, "a", "HIGH", "ADD"), (2, "b", "HIGH", "SKIP"), (3, "c", "LOW", "ADD"), (4, "d", "HIGH", "ADD")]
    manifest = spark.createDataFrame(rows, "number long, item string, severity string, recommendation string")
    choices = spark.createDataFrame([(3, "A"), (4, "S"), (9, "A")], "number long, choice string")
    assert {r.number for r in drift.apply_approvals(manifest, choices, "HIGH").collect()} == {1, 3}


def test_best_class_against_all_pairs(spark, monkeypatch):
    import random

    from tidemark.operators import watch

    monkeypatch.setattr(watch, "RARE_COLUMN", 5)
    rng = random.Random(3)
    draw = lambda k: {f"{k}{i}": {*rng.sample("ABCDEFGH", rng.randint(1, 7)), *rng.sample(["R1", "R2", f"R{i % 9}", f"{k}_{i}"], 2)} for i in range(60)}
    tables, classes = draw("t"), draw("c")
    frame = lambda sets: spark.createDataFrame([(n, c) for n, s in sets.items() for c in sorted(s)] + [(None, "A")], "name string, column_name string")
    want = {}
    for t, s in tables.items():
        j, c = min((-len(s & k) / len(s | k), c) for c, k in classes.items())
        if -j >= 0.7:
            want[t] = (c, round(-j, 4))
    assert want and {r.table_name: (r.class_name, r.similarity) for r in watch.match_class(frame(tables), frame(classes)).collect()} == want


def test_equal_frequent_columns_are_one_row(spark):
    """400 tables and classes of the same eight columns and one of their own: no pair of them is written."""
    from tidemark.operators import watch

    frame = lambda k: spark.range(400).selectExpr(f"concat('{k}', id) as name", f"explode(split('A,B,C,D,E,F,G,H,{k}' || id, ',')) as column_name")
    found = watch.match_class(frame("t"), frame("c"))
    assert {(r.class_name, r.similarity) for r in found.collect()} == {("c0", 0.8)} and found.count() == 400
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_rare_first" in plan and "_often_first" in plan


def test_facts_and_dimensions_are_not_grouped_by_pair(spark, monkeypatch):
    from tidemark.operators import relations

    monkeypatch.setattr(relations, "TABLES_PER_BLOCK", 2)
    rows = [(f"FCT_{i}", c) for i in range(7) for c in ("A_ID", "B_KEY", "Z")] + [("dim_x", "B_KEY"), ("dim_x", "A_ID"), ("DIM_Y", "b_key"), ("DIM_FCT_", "Q_ID"), ("DIM_N", None)]
    columns = spark.createDataFrame([("D", "S", *r) for r in rows] * 2, "database_name string, schema_name string, table_name string, column_name string")
    found = relations.fact_dim_relations(columns)
    got = {(r.left_table, r.right_table): r.relationship_columns for r in found.collect()}
    want = {(f"fct_{i}", d): k for i in range(7) for d, k in (("dim_x", "A_ID,B_KEY"), ("dim_y", "B_KEY"))} | {("dim_fct_", "dim_fct_"): "Q_ID"}
    assert got == want and found.count() == len(want)
    assert "hashpartitioning(database_name" not in found._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]


def test_common_reference_is_looked_up_once_a_schema(spark):
    from tidemark.operators import relations

    rows = [("D", "S", f"T{i}", c) for i in range(50) for c in ("ID", "ORDER_ID", "order_id")] + [("D", "S", "ORDERS", "ID"), (None, "S", "LONE", "ORDER_ID")]
    columns = spark.createDataFrame(rows, "database_name string, schema_name string, table_name string, column_name string")
    found = relations.relations_inferred(columns)
    assert {(r.source_table, r.source_column, r.target_table) for r in found.collect()} == {
        *((f"D.S.T{i}", c, "D.S.ORDERS") for i in range(50) for c in ("ORDER_ID", "order_id")), ("S.LONE", "ORDER_ID", "D.S.ORDERS")
    }
    # the names are made distinct before they are taken apart into options
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(plan) if "posexplode" in x)
    assert any("Aggregate [database_name" in x for x in plan[at : at + 3])


def test_catalog_columns_are_spread(spark, small):
    from tidemark.plans.inputs import Inputs

    t = Inputs(spark, small)
    assert t.catalog_columns.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_pieces_of_metric_names_are_not_shuffled_to_be_distinct(spark):
    from tidemark.operators import questions

    columns = spark.createDataFrame([("sales", "D", "S", t) for t in ("AA", "A", "x")], "domain string, database_name string, schema_name string, table_name string")
    metrics = spark.createDataFrame([("sales", "aaa_aa", "SUM(1)")] * 2 + [("sales", None, "SUM(1)")], "domain string, metric_name string, expr string")
    found = questions.spec_metrics(columns, metrics)
    assert sorted(r.logical_table for r in found.collect()) == ["a", "aa"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "logical_table" not in [x for x in plan.splitlines() if "Aggregate [domain" in x and "metric_name" in x][0]


def test_pairs_are_not_shuffled_by_database(spark):
    from tidemark.operators import questions

    columns = spark.createDataFrame([("sales", "D"), ("sales", "E")], "domain string, database_name string")
    relations = spark.createDataFrame([("D", "a_to_b", "a", "b", "X_ID")], "database_name string, name string, left_table string, right_table string, relationship_columns string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a catalog whose estimate is above it
    try:
        found = questions.spec_relations(columns, relations)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert [(r.name, r.relation) for r in found.collect()] == [("sv_sales", "a_to_b")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_names_without_a_third_option_do_not_meet(spark):
    """References whose name has no third option shared a null, so all of them lay in one task of the look-up."""
    from tidemark.operators import relations

    rows = [("d", "s", "T%d" % i, c, n) for i in range(20) for n, c in enumerate(("ID", f"T{i + 1}_ID", "BOSS_ID"), 1)] + [("d", "s", "BOS", "ID", 1)]
    columns = spark.createDataFrame(rows, "database_name string, schema_name string, table_name string, column_name string, ordinal int")
    out = relations.relations_inferred(columns)
    assert "isnotnull(_o" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.source_table, r.target_table) for r in out.collect()}
    assert got == {(f"d.s.T{i}", f"d.s.T{i + 1}") for i in range(19)} | {(f"d.s.T{i}", "d.s.BOS") for i in range(20)}


def test_relations_are_sorted_in_a_named_number_of_parts(spark, small):
    found = load_all()["merge_relations"].run(spark, small)
    assert found.rdd.getNumPartitions() >= 16 * spark.sparkContext.defaultParallelism  # was 1


@pytest.mark.parametrize("name", ["merge_relations", "conflict_summary", "graduation_ready"])
def test_relations_are_not_broadcast(spark, small, name):
    plan = load_all()[name].run(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and ("full_name" in x or "ref_table" in x)]


def _random_keys(spark):
    """Facts and dimensions of two databases with keys in few and in many tables, repeated and null rows."""
    import random

    r = random.Random(5)
    keys = [*"ABC", *(f"R{i}" for i in range(12))]
    rows = []
    for db in ("D", "E", None):
        for i in range(14):
            for name in (f"FCT_{i}", f"dim_{i}", f"T{i}"):
                rows += [(db, r.choice(["S", "T"]), name, f"{k}_{r.choice(['ID', 'id'])}") for k in r.sample(keys, r.randint(0, 4))]
    rows += rows[:40] + [("D", "S", None, "A_ID"), ("D", "S", "FCT_X", None), ("D", "S", "FCT_DIM_", "A_KEY"), ("D", "S", "FCT_DIM_", "B_ID")]
    tables = {}
    for db, _, t, c in rows:
        if db and t and c:
            tables.setdefault((db, t.upper()), set()).add(c.upper())
    want = {}
    for (db, f), a in tables.items():
        for (other, d), b in tables.items():
            if db == other and "FCT_" in f and "DIM_" in d and a & b:
                want[db, f.lower(), d.lower()] = ",".join(sorted(a & b)[:3])
    return spark.createDataFrame(rows, "database_name string, schema_name string, table_name string, column_name string"), want


@pytest.mark.parametrize("block", [1, 2, 4, 1024])
def test_pairs_and_their_numbers_are_whole_for_frequent_and_rare_keys(spark, monkeypatch, block):
    from collections import Counter

    from tidemark.operators import relations

    monkeypatch.setattr(relations, "TABLES_PER_BLOCK", block)
    columns, want = _random_keys(spark)
    got = relations.fact_dim_relations(columns).collect()
    assert {(r.database_name, r.left_table, r.right_table): r.relationship_columns for r in got} == want and len(got) == len(want)
    assert all(r.name == f"{r.left_table}_to_{r.right_table}" for r in got)
    counted = relations.fact_dim_relations(columns, counted=True).collect()
    assert {(r.database_name, r.left_table): r.pairs for r in counted} == Counter(x[:2] for x in want) and len(counted) == len({x[:2] for x in want})


def test_blocks_of_tables_are_dealt_as_rows(spark, monkeypatch):
    """Each table was written once for each block of the other side, with all its keys."""
    from tidemark.operators import relations

    monkeypatch.setattr(relations, "TABLES_PER_BLOCK", 4)
    columns = spark.range(40).selectExpr("'D' as database_name", "'S' as schema_name", "concat(if(id < 20, 'FCT_', 'DIM_'), id) as table_name", "'A_ID' as column_name")
    dealt, kind = [], type(columns)
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, *by: (dealt.append(df), plain(df, *by))[1])
    assert relations.fact_dim_relations(columns).count() == 400
    assert len(dealt) == 2 and all(df.count() <= 25 for df in dealt)  # was 100


def test_name_of_a_specification_is_made_once_a_database(spark):
    from tidemark.operators import questions

    columns = spark.createDataFrame([("R & D", "D"), ("R & D", "D"), ("r_&_d", "D")], "domain string, database_name string")
    relations = spark.createDataFrame([("D", "a_to_b", "a", "b", "X_ID")], "database_name string, name string, left_table string, right_table string, relationship_columns string")
    found = questions.spec_relations(columns, relations)
    assert [r.name for r in found.collect()] == ["sv_r_and_d"] * 2  # a row for each domain
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_specification_counts_relations_without_their_pairs(spark, small):
    from tidemark.operators import questions

    plan = load_all()["semantic_spec"].run(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "pairs" in plan and "_to_" not in plan and "explode(_rv" not in plan
    columns = spark.createDataFrame([("X", "D", "S", "FCT_A", "A_ID", "NUMBER", 1), ("X", "D", "S", "T", "N", "VARCHAR", 1)], "domain string, database_name string, schema_name string, table_name string, column_name string, data_type string, ordinal int")
    verified = spark.createDataFrame([("X",)], "domain string")
    for links in ([("D", "fct_a", 2), ("D", "fct_a", 3)], [("D", "fct_a")] * 5):
        relations = spark.createDataFrame(links, ["database_name", "left_table", "pairs"][: len(links[0])])
        got = {r.logical_table: r.relationships for r in questions.semantic_spec(columns, relations, verified).collect()}
        assert got == {"fct_a": 5, "t": 0}


def test_text_of_a_query_is_derived_once(spark):
    from tidemark.operators import sqlmining

    log = spark.createDataFrame([(1, "D", "q", "SELECT 1"), (2, "D", "q", "update t"), (3, "D", "", "SELECT 1"), (4, "D", "q", ""), (5, "D", "q", None), (6, "D", None, "SELECT 1"), (7, None, "q", "Created"), (8, None, "q", "x")], "query_id long, domain string, question string, raw string")
    found = sqlmining.verified_queries(log.selectExpr("query_id", "domain", "question", "replace(raw, '1', '2') as query_text"))
    assert sorted((r.domain, r.name, r.sql) for r in found.collect()) == [("D", "vqr_1", "SELECT 2"), ("Unknown", "vqr_8", "x")]
    plan = found.select("domain").groupBy("domain").count()._jdf.queryExecution().optimizedPlan().toString()
    assert max(x.count("replace(raw") for x in plan.splitlines()) == 1  # was 4
