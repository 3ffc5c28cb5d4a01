"""Near copies: only pairs that may be alike are written, and shingles are shuffled once."""

import itertools
import random

import pytest

from tidemark.operators import reviews as V


@pytest.fixture
def written(monkeypatch):
    """Columns, rows and plan of what is written on the way."""
    seen, write = [], V.durable

    def noted(df):
        out = write(df)
        seen.append((out.columns, out.count(), df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(V, "durable", noted)
    return seen


def _pieces(n):
    rng = random.Random(8)
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(n)]


def test_pairs_that_cannot_be_alike_are_not_written(spark, written):
    # any two texts with a common piece share its shingles, a third of both, and no shingle is in one text only
    docs = [(i, f"{a} {b}") for i, (a, b) in enumerate(itertools.permutations(_pieces(7), 2))]
    docs += [(100, docs[3][1] + " end"), (101, docs[9][1] + " other end")]
    found = {r.doc_id: r.keeper for r in V.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    order = {i: t.split() for i, t in docs}
    swapped = {i: next(k for k, w in order.items() if k < 100 and w == t[40:] + t[:40]) for i, t in order.items() if i < 100}
    want = {i: k for i, k in swapped.items() if i < k} | {3: 100, 9: 101, swapped[3]: 100, swapped[9]: 101}
    assert found == want
    assert 0 < sum(n for columns, n, _ in written if columns[:2] == ["doc", "rep"]) <= 3 * len(want)


def test_shingles_are_shuffled_once_and_no_side_is_broadcast(spark, written):
    docs = [(i, f"{a} {b}") for i, (a, b) in enumerate(itertools.permutations(_pieces(4), 2))]
    V.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert not [1 for *_, plan in written if "Broadcast" in plan]
    assert not any("shingles" in columns for columns, *_ in written)  # the sets of all texts


def test_rounds_without_pairs_double_the_heads(spark, written):
    # 13 texts hold each piece, no two are alike: 12 rounds of one head each before
    docs = [(i, f"{a} {b}") for i, (a, b) in enumerate(itertools.combinations(_pieces(14), 2))]
    assert V.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), reps=1).collect() == []
    assert 3 <= len([1 for columns, *_ in written if {"s", "doc"} <= set(columns)]) <= 5


def test_repeated_and_missing_ids_and_texts(spark):
    base = _pieces(3)
    rows = [(1, base[0]), (1, base[1]), (2, base[0] + " x"), (3, base[1] + " y"), (3, base[1] + " y"), (None, base[2]), (4, base[2] + " z"), (5, None), (6, None), (7, "")]
    found = {r.doc_id: r.keeper for r in V.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {1: 3}
    assert V.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
