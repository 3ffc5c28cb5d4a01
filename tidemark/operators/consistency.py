"""How far repeated runs agree, what they assert, and whether their parts fit together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import as_large, rounded

# Weights of the six dimensions of a build plan.
PLAN_WEIGHTS = {"objects": 20, "structure": 30, "sequence": 15, "row_counts": 10, "features": 15, "artifacts": 10}


def core_name(name: Column) -> Column:
    """Upper-case name without database and schema."""
    return F.element_at(F.split(F.upper(name), r"\."), -1)


def canonical_type(kind: Column) -> Column:
    """Equivalent type names made one; precision stays."""
    k = F.upper(kind)
    return F.when(k.isin("STRING", "TEXT"), "VARCHAR").when(k == "TIMESTAMP", "TIMESTAMP_NTZ").otherwise(k)


def _votes(items: DataFrame, name: str, column: str, runs: int) -> DataFrame:
    """Mean agreement over the union of items: all runs 1, all but one a half, less 0."""
    n = items.distinct().groupBy("plan_id", column).agg(F.count(F.lit(1)).alias("_n"))
    score = F.when(F.col("_n") == runs, 1.0).when(F.col("_n") == runs - 1, 0.5).otherwise(0.0)
    return n.groupBy("plan_id").agg(F.avg(score).alias(name))


def convergence(objects: DataFrame, columns: DataFrame, features: DataFrame, artifacts: DataFrame, runs: int = 3) -> DataFrame:
    """Agreement of the runs of each plan in six dimensions and in total, in percent.

    objects: plan_id, run, name, object_type, position, row_count; columns: plan_id, run,
    name, ordinal, column_name, data_type; features and artifacts: plan_id, run, item.
    """
    o = objects.withColumns({"name": core_name(F.col("name")), "object_type": F.upper("object_type")})
    named = o.select("plan_id", "run", F.concat_ws(":", "name", "object_type").alias("item"))
    line = F.struct("ordinal", F.concat_ws("|", F.upper("column_name"), canonical_type(F.col("data_type"))).alias("c"))
    tables = columns.withColumn("name", core_name(F.col("name"))).groupBy("plan_id", "run", "name").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["c"]), ";"), 256).alias("_h")  # the columns of one table
    )
    per_hash = tables.groupBy("plan_id", "name", "_h").agg(F.count(F.lit(1)).alias("_c"))
    per_table = per_hash.groupBy("plan_id", "name").agg(F.max("_c").alias("_m"), F.sum("_c").alias("_n")).filter(F.col("_n") >= 2)
    structure = per_table.groupBy("plan_id").agg(F.avg(F.when(F.col("_m") == runs, 1.0).when(F.col("_m") == runs - 1, 0.5).otherwise(0.0)).alias("structure"))
    places = o.groupBy("plan_id", "name").agg(F.count_distinct("run").alias("_n"), (F.min("position") == F.max("position")).alias("_same"))
    sequence = places.groupBy("plan_id").agg(
        F.when(F.bool_and(F.col("_n") == runs) & F.bool_and("_same"), 1.0).when(F.bool_and(F.col("_n") == runs), 0.5).otherwise(0.0).alias("sequence")
    )
    counts = o.filter(F.col("row_count").isNotNull()).groupBy("plan_id", "name").agg(
        F.count(F.lit(1)).alias("_n"), F.min("row_count").alias("_lo"), F.max("row_count").alias("_hi")
    ).filter(F.col("_n") >= 2)
    near = (F.col("_hi") - F.col("_lo")) <= F.col("_hi") * 0.2
    rows = counts.groupBy("plan_id").agg(F.avg(F.when(F.col("_lo") == F.col("_hi"), 1.0).when(near, 0.75).otherwise(0.0)).alias("row_counts"))
    parts = [
        _votes(named, "objects", "item", runs), structure, sequence, rows,
        _votes(features.select("plan_id", "run", F.upper("item").alias("item")), "features", "item", runs),
        _votes(artifacts.select("plan_id", "run", F.upper("item").alias("item")), "artifacts", "item", runs),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "plan_id", "left")
    total = sum((F.coalesce(F.col(c), F.lit(1.0)) * w for c, w in PLAN_WEIGHTS.items()), F.lit(0.0))
    return out.select("plan_id", *[rounded(F.coalesce(F.col(c), F.lit(1.0)), 4).alias(c) for c in PLAN_WEIGHTS], rounded(total, 1).alias("convergence"))


def convergence_verdict(scored: DataFrame) -> DataFrame:
    """Verdict of each plan by its convergence."""
    c = F.col("convergence")
    return scored.withColumn(
        "verdict", F.when(c >= 90, "DETERMINISTIC").when(c >= 70, "MOSTLY_DETERMINISTIC").when(c >= 50, "DIVERGENT").otherwise("NON_DETERMINISTIC")
    )


def consensus(fields: DataFrame) -> DataFrame:
    """Value of each field that at least two runs share, else that of the first run.

    Needs plan_id, item, field, run, value.
    """
    key = ["plan_id", "item", "field"]
    votes = fields.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("_n"), F.min("run").alias("_r"))
    order = F.struct(-F.when(F.col("_n") >= 2, F.col("_n")).otherwise(F.lit(1)), F.col("_r"))
    return votes.groupBy(*key).agg(F.min_by("value", order).alias("value"), F.max("_n").alias("votes"))


def assertions(results: DataFrame, rules: DataFrame) -> DataFrame:
    """Outcome of each assertion over the runs of a test.

    results: test_id, run, field, value (text); rules: test_id, field, expected, which is
    true or false, a comparison such as ">= 3", or "contains: text".
    """
    e, v = F.col("expected"), F.col("value")
    op = F.regexp_extract(e, r"^\s*(>=|<=|==|>|<)", 1)
    limit = F.regexp_extract(e, r"^\s*(?:>=|<=|==|>|<)\s*(-?[0-9.]+)", 1).try_cast("double")
    x = v.try_cast("double")
    compared = F.when(op == ">=", x >= limit).when(op == "<=", x <= limit).when(op == "==", x == limit).when(op == ">", x > limit).when(op == "<", x < limit)
    needle = F.regexp_extract(e, r"(?s)^contains: (.*)$", 1)
    passed = F.when(op != "", compared).when(needle != "", v.contains(needle)).otherwise(F.lower(v) == F.lower(e))
    joined = rules.join(results, ["test_id", "field"], "left").withColumn("_p", F.coalesce(passed, F.lit(False)))
    return joined.groupBy("test_id", "field", "expected").agg(F.count("run").alias("runs"), F.count_if("_p").alias("passed_runs")).withColumn(
        "status", F.when((F.col("passed_runs") == F.col("runs")) & (F.col("runs") > 0), "PASS").when(F.col("passed_runs") > 0, "WARN").otherwise("FAIL")
    )


def _band(score: Column) -> Column:
    return F.when(score >= 90, "EXCELLENT").when(score >= 75, "GOOD").when(score >= 60, "ACCEPTABLE").otherwise("POOR")


def field_consistency(results: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted agreement of numeric fields over the runs of a test; weights: field, weight."""
    spread = results.groupBy("test_id", "field").agg((F.max(F.col("value").try_cast("double")) - F.min(F.col("value").try_cast("double"))).alias("_s"))
    s = F.col("_s")
    score = F.when(s == 0, 1.0).when(s <= 1, 0.8).when(s <= 2, 0.5).otherwise(0.0)
    out = spread.join(weights, "field").groupBy("test_id").agg(F.sum(score * F.col("weight")).alias("_t"), F.sum("weight").alias("_w"))
    return out.select("test_id", rounded(F.col("_t") / F.col("_w") * 100, 2).alias("consistency_pct")).withColumn("band", _band(F.col("consistency_pct")))


def length_consistency(outputs: DataFrame) -> DataFrame:
    """Agreement of the output lengths over the runs of a test."""
    n = F.length("output")
    g = outputs.groupBy("test_id").agg(F.max(n).alias("_hi"), F.min(n).alias("_lo"))
    spread = F.try_divide((F.col("_hi") - F.col("_lo")).cast("double"), F.col("_hi"))
    score = F.when(spread <= 0.10, 100.0).when(spread <= 0.25, 80.0).otherwise(50.0)
    return g.select("test_id", rounded(spread, 4).alias("spread"), score.alias("consistency_pct")).withColumn("band", _band(F.col("consistency_pct")))


def artifact_audit(setup: DataFrame, references: DataFrame, stated_rows: DataFrame, teardown: DataFrame) -> DataFrame:
    """Faults between what a lab sets up, refers to, states and tears down.

    setup: lab_id, table_name, column_name, row_count (one row per column); references:
    lab_id, table_name, column_name (or null); stated_rows: lab_id, table_name, row_count;
    teardown: lab_id, table_name.
    """
    tables = as_large(setup.groupBy("lab_id", "table_name").agg(F.max("row_count").alias("_rows")))
    finding = lambda df, kind: df.select("lab_id", F.lit(kind).alias("finding"), "item")
    named = lambda df: df.withColumn("item", F.col("table_name"))
    key = ["lab_id", "table_name"]
    used = as_large(references.select(*key).distinct())
    missing = named(used.join(tables, key, "left_anti"))
    no_column = (
        references.filter(F.col("column_name").isNotNull()).join(tables, key, "left_semi")
        .join(as_large(setup.select(*key, "column_name").distinct()), [*key, "column_name"], "left_anti")
        .select(*key, F.concat_ws(".", "table_name", "column_name").alias("item")).distinct()
    )
    wrong = named(stated_rows.join(tables, key).filter(F.col("row_count") != F.col("_rows")))
    left = named(tables.join(as_large(teardown.select(*key).distinct()), key, "left_anti"))
    unused = named(tables.join(used, key, "left_anti"))
    return (
        finding(missing, "MISSING_TABLE").unionByName(finding(no_column, "MISSING_COLUMN")).unionByName(finding(wrong, "ROW_COUNT_MISMATCH"))
        .unionByName(finding(left, "NOT_TORN_DOWN")).unionByName(finding(unused, "UNUSED_TABLE"))
    )
