"""Readers for files that hold SQL queries, and a writer for nested result documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COLUMNS = ["kind", "path", "position", "sql", "metadata"]


def read_query_csv(spark: SparkSession, path: str, sql_column: str = "SQL", recursive: bool = False) -> DataFrame:
    """Queries of CSV files, each with a header of its own; all other columns become metadata.

    Rows without SQL are dropped, and so are files without that column. A quoted cell may span lines; a header may not.
    """
    opened = {"recursiveFileLookup": recursive, "pathGlobFilter": "*.csv"}
    lines = spark.read.options(**opened).text(path).select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("_at"))
    heads = lines.groupBy("path").agg(F.min_by("value", "_at").alias("value"))
    width = heads.agg(F.max(F.size(F.split("value", ",")))).first()[0]
    if width is None:
        return _empty(spark)
    schema = ", ".join(f"c{i} string" for i in range(width))
    cells = (
        spark.read.schema(schema).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").options(**opened).csv(path)
        .select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("position"), F.array(*[f"c{i}" for i in range(width)]).alias("cells"))
    )
    # the first row of a file names its columns; of names that repeat the first counts
    header = cells.groupBy("path").agg(F.min("position").alias("_first"), F.min_by("cells", "position").alias("names"))
    pairs = F.transform("names", lambda name, i: F.struct(name.alias("key"), F.coalesce(F.get("cells", i), F.lit("")).alias("value"), i.alias("i")))
    named = F.filter(pairs, lambda p: p["key"].isNotNull() & (F.array_position("names", p["key"]) == p["i"] + 1))
    row = cells.join(header, "path").filter(F.col("position") > F.col("_first")).select(
        "path", "position", F.map_from_entries(F.transform(named, lambda p: F.struct(p["key"], p["value"]))).alias("row")
    )
    sql = F.try_element_at("row", F.lit(sql_column))
    return row.filter(F.coalesce(sql, F.lit("")) != "").select(
        F.lit("csv").alias("kind"), "path", "position", F.trim(sql).alias("sql"), F.map_filter("row", lambda k, _: k != sql_column).alias("metadata")
    )


def read_query_json(spark: SparkSession, path: str, recursive: bool = False, glob: str = "*.json") -> DataFrame:
    """Queries of JSON files that hold an array of texts and objects with a `sql` key.

    An object without it is ignored, and so is a file that is no array.
    """
    files = (
        spark.read.text(path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter=glob)
        .select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
        .filter(F.schema_of_variant("v").startswith("ARRAY"))
    )
    items = files.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("path", F.col("pos").alias("position"), F.col("value").alias("item"))
    kind = F.schema_of_variant("item")
    whole = F.variant_get("item", "$", "string")
    fields = F.from_json(F.to_json("item"), "map<string,string>")
    is_object = kind.startswith("OBJECT")
    sql = F.when(is_object, F.try_variant_get("item", "$.sql", "string")).when(kind == "STRING", whole)
    meta = F.when(is_object, F.map_filter(fields, lambda k, _: k != "sql")).otherwise(F.create_map().cast("map<string,string>"))
    return items.select(F.lit("json").alias("kind"), "path", F.col("position").cast("bigint").alias("position"), sql.alias("sql"), meta.alias("metadata")).filter(F.col("sql").isNotNull())


def read_query_sql(spark: SparkSession, path: str, recursive: bool = False, glob: str = "*.sql") -> DataFrame:
    """One query per SQL file, with its path as metadata."""
    return (
        spark.read.text(path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter=glob)
        .select(
            F.lit("sql").alias("kind"), F.col("_metadata.file_path").alias("path"), F.lit(0).cast("bigint").alias("position"), F.col("value").alias("sql"),
            F.create_map(F.lit("file"), F.col("_metadata.file_path")).alias("metadata"),
        )
    )


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "kind string, path string, position bigint, sql string, metadata map<string,string>")


def read_query_path(spark: SparkSession, path: str, sql_column: str = "SQL") -> DataFrame:
    """Reader by suffix; a path without one is a folder. Other suffixes are refused."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    suffix = name.rsplit(".", 1)[-1] if "." in name else ""
    if suffix == "csv":
        return with_index(read_query_csv(spark, path, sql_column))
    if suffix == "json":
        return with_index(read_query_json(spark, path))
    if suffix == "sql":
        return with_index(read_query_sql(spark, path))
    if suffix:
        raise ValueError(f"Unknown file type: .{suffix}")
    return read_query_dir(spark, path, sql_column)


def read_query_dir(spark: SparkSession, path: str, sql_column: str = "SQL") -> DataFrame:
    """All queries under a folder, numbered from 1; a malformed file yields no rows."""
    parts = [read_query_csv(spark, path, sql_column, True), read_query_json(spark, path, True), read_query_sql(spark, path, True)]
    return with_index(reduce(DataFrame.unionByName, parts))


def with_index(queries: DataFrame) -> DataFrame:
    """Number from 1 by kind, path and position: a running count of files plus the place in the file."""
    key = ["kind", "path"]
    sizes = queries.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("position"))
    return queries.join(starts, key).withColumn("index", (place + F.col("_o")).cast("bigint")).select("index", *COLUMNS)


def write_documents(df: DataFrame, path: str, mode: str = "error") -> None:
    """Nested rows as JSON lines, one file per partition."""
    df.write.mode(mode).json(path)


def summary_document(summary: DataFrame) -> DataFrame:
    """The totals of a run as one nested document."""
    return summary.select(F.struct(*summary.columns).alias("summary"))


def consolidated_documents(usage: DataFrame, block: int = 100_000) -> DataFrame:
    """Tables by class, each with the sorted queries that use it.

    `usage` holds table_name, table_class and query_index. A table comes in documents of `block` query numbers, so that a
    table which a third of the log uses never has to fit into one of them; most tables have one.
    """
    group = F.when(F.col("table_class") == "other", "other_tables").otherwise(F.concat("table_class", F.lit("_tables")))
    return usage.groupBy(group.alias("group"), F.col("table_name").alias("table"), F.floor(F.col("query_index") / block).alias("block")).agg(
        F.array_sort(F.collect_set("query_index")).alias("used_in_queries")
    )


def write_extraction(processed: DataFrame, summary: DataFrame, usage: DataFrame, path: str, consolidated: bool = True, mode: str = "error") -> None:
    """Writes a run as `summary`, `queries` and, if asked for, `consolidated` documents below `path`."""
    write_documents(summary_document(summary), f"{path}/summary", mode)
    write_documents(query_documents(processed), f"{path}/queries", mode)
    if consolidated:
        write_documents(consolidated_documents(usage), f"{path}/consolidated", mode)


def query_documents(processed: DataFrame) -> DataFrame:
    """One nested document per processed query."""
    return processed.select(
        "index", "skipped", "reason", "tables",
        F.transform("columns", lambda c: F.struct(c["alias"].alias("alias"), c["name"].alias("column"))).alias("columns"),
        F.struct("domain", "question").alias("metadata"),
    )


