"""Readers for run records, catalog snapshots and staged files, and a comparison of data sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import durable

RUN_SCHEMA = (
    "run_id string, skill_name string, review_mode string, model string, start_epoch double, end_epoch double, "
    "duration_seconds double, status string, _bad string"
)


def read_completed_runs(
    spark: SparkSession, path: str, as_of_epoch: float, days: int = 30, skill: str | None = None, mode: str | None = None, model: str | None = None
) -> DataFrame:
    """Finished runs of the last days; unreadable ones are ignored.

    A file holds one JSON object, indented or not, or one object per line. A record file is small, so it is read whole.
    """
    files = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    by_line = F.try_parse_json(F.element_at(F.split("value", "\n"), 1)).isNotNull()
    records = files.select(F.explode(F.when(by_line, F.split("value", "\n")).otherwise(F.array("value"))).alias("value"))
    parsed = F.from_json("value", RUN_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    runs = records.select(parsed.alias("r")).select("r.*")
    kept = runs.filter(F.col("_bad").isNull() & F.col("run_id").isNotNull() & (F.col("end_epoch") >= as_of_epoch - days * 86400)).drop("_bad")
    for column, value in (("skill_name", skill), ("review_mode", mode), ("model", model)):
        if value is not None:
            kept = kept.filter(F.col(column) == value)
    return kept


def live(df: DataFrame, ignored: Sequence[str] = (), metadata_schema: str = "INFORMATION_SCHEMA") -> DataFrame:
    """Rows of objects that still exist, outside the metadata schema and the ignored ones."""
    out = df.filter("not coalesce(is_deleted, false)") if "is_deleted" in df.columns else df
    if "schema_name" in out.columns:
        out = out.filter(~F.upper("schema_name").isin(metadata_schema, *[s.upper() for s in ignored]))
    return out


def read_catalog_snapshot(tables: DataFrame, columns: DataFrame, constraints: DataFrame, ignored: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Databases, schemas, tables, columns and constraints of a catalog, deleted objects left out of all five."""
    t = live(tables, ignored)
    key = ["database_name", "schema_name", "table_name"]
    names = t.select(*key).distinct()
    return {
        "databases": t.select("database_name").distinct(),
        "schemata": t.select("database_name", "schema_name").distinct(),
        "tables": t,
        "columns": live(columns, ignored).join(names, key, "left_semi"),
        "constraints": live(constraints, ignored).join(names, key, "left_semi"),
    }


def infer_schema(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    """Names and types of the columns of staged files, as rows."""
    schema = spark.read.options(**options).format(fmt).load(path).schema
    return spark.createDataFrame([(i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(schema.fields)], "position bigint, column_name string, data_type string, nullable boolean")


def dataset_diff(test: DataFrame, baseline: DataFrame, sample: int | None = None) -> DataFrame:
    """Row counts of two data sets, and the rows that only one of them has (`sample` of them at most, if given).

    Rows are compared by a hash of the columns of both, counted on both sides. Each value is written with its
    length, and a null as "n", so different rows are different texts. A column that one side lacks is null there.
    """
    names = sorted({*test.columns, *baseline.columns})

    def written(df: DataFrame, name: str):
        text = F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("n"))

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.sha2(F.concat(*[written(df, c) for c in names]), 256).alias("row_hash")).agg(F.count(F.lit(1)).alias(name))

    both = counted(test, "test_count").join(counted(baseline, "baseline_count"), "row_hash", "full_outer").fillna(0, ["test_count", "baseline_count"])
    differing = both.filter(F.col("test_count") != F.col("baseline_count"))
    if sample is not None:
        differing = differing.orderBy("row_hash").limit(sample)
    total = both.agg(
        F.lit("TOTAL").alias("row_hash"), F.coalesce(F.sum("test_count"), F.lit(0)).alias("test_count"), F.coalesce(F.sum("baseline_count"), F.lit(0)).alias("baseline_count")
    )
    return total.unionByName(differing)


def nesting(text: Column) -> Column:
    """How deep a JSON text nests objects and arrays: brackets outside of strings, counted up and down."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), '"[^"]*"', "")
    steps = F.transform(F.split(F.regexp_replace(bare, r"[^\[\]{}]+", ""), ""), lambda x: F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(steps, start, lambda a, x: F.struct((a["now"] + x).alias("now"), F.greatest(a["most"], a["now"] + x).alias("most")))["most"]


def json_paths(df: DataFrame, column: str, max_depth: int | None = None, min_share: float | None = None, max_keys: int | None = None) -> DataFrame:
    """Paths of a JSON text column with value type and count, from the whole column.

    One scan finds the deepest nesting, a second one takes all values apart, level by level within a task. A container
    hands the note that it was there to its first child, so that each value is written once and nothing is kept between
    levels. If given: paths in fewer rows than the share and deeper than the depth are dropped; at most `max_keys`
    top-level keys stay, the most frequent ones.
    """
    spark = df.sparkSession
    parsed = df.select(F.col(column).alias("text"), F.try_parse_json(column).alias("v")).filter(F.col("v").isNotNull())
    deepest = parsed.agg(F.max(nesting(F.col("text")))).first()[0] or 0
    entry = F.struct("path", "head", value_type(F.col("v")).alias("value_type"), F.col("depth").cast("bigint").alias("depth"))
    nothing = F.lit(None).cast("string")
    rows = parsed.select("v", nothing.alias("path"), nothing.alias("head"), F.lit(0).alias("depth"))
    rows = rows.withColumn("noted", F.filter(F.array(entry), lambda x: F.lit(False)))
    for level in range(1, (deepest if max_depth is None else min(deepest, max_depth)) + 1):
        step = F.coalesce(F.concat(F.lit("."), F.col("key")), F.lit("[]"))
        down = F.col("value").isNotNull()  # a JSON null is a value
        noted = F.when(~down, F.col("noted")).when(F.col("pos") > 0, F.slice("noted", 1, 0)).when(F.col("depth") > 0, F.array_append("noted", entry)).otherwise(F.col("noted"))
        rows = rows.lateralJoin(spark.tvf.variant_explode_outer(F.when(F.col("depth") == level - 1, F.col("v")).outer())).select(
            F.coalesce("value", "v").alias("v"),
            F.when(down, F.concat(F.coalesce("path", F.lit("")), step)).otherwise(F.col("path")).alias("path"),
            (F.when(down, step).otherwise(nothing) if level == 1 else F.col("head")).alias("head"),
            F.when(down, level).otherwise(F.col("depth")).alias("depth"),
            noted.alias("noted"),
        )
    all_of_row = F.when(F.col("depth") > 0, F.array_append("noted", entry)).otherwise(F.col("noted"))
    counted = rows.select(F.explode(all_of_row).alias("e")).select("e.*").groupBy("path", "head", "value_type", "depth").agg(F.count(F.lit(1)).alias("occurrences"))
    if min_share is not None:
        counted = counted.filter(F.col("occurrences") >= df.select(F.count(F.try_parse_json(column))).scalar() * min_share)
    if max_keys is not None:
        top = counted.filter("depth = 1").groupBy("head").agg(F.sum("occurrences").alias("_n")).orderBy(F.desc("_n"), "head").limit(max_keys).select("head")
        counted = counted.join(F.broadcast(top), "head", "left_semi")  # at most max_keys rows
    return counted.groupBy("path", "value_type", "depth").agg(F.sum("occurrences").alias("occurrences")).select("path", "value_type", "occurrences", "depth")


def value_type(v: Column) -> Column:
    """Kind of a variant value without the inner schema."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)
