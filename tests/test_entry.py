import __spark_entry__ as entry_module
from tidemark.plans import load_all


def test_flagship_runs(spark):
    df = entry_module.entry(spark)
    assert df.columns[:2] == ["object_a", "object_b"]
    assert df.count() > 0


def test_every_check_belongs_to_a_query():
    queries, checks = entry_module.queries(), entry_module.oracle_sql()
    assert set(checks) <= set(queries)
    own = set(load_all())
    assert own - set(checks) == {"train_and_score", "near_duplicates"}
