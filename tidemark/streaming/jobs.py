"""Streaming forms of the polled jobs. Each takes a streaming DataFrame and returns one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exact import percent
from tidemark.operators.catalog import TABLE_KEY, delta_upsert
from tidemark.operators.watch import ontology_drift, triage


def event_time(df: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Event time with a watermark; zoneless times are read as UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_failures(history: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Failed runs, each reported once within the watermark."""
    failed = history.filter(F.col("state").isin("FAILED", "UPSTREAM_FAILED"))
    return event_time(failed, delay=delay).dropDuplicatesWithinWatermark(["object_name", "object_type", "ts"]).select(
        "object_name", "object_type", "ts", "message"
    )


def stream_cost_window(audit: DataFrame, limit: int = 50, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Hours with more model calls than allowed, once the hour is complete."""
    calls = audit.filter(F.col("action_type").isin("DIAGNOSE", "DIAGNOSE_DT") & (F.col("model_used") != "RUNBOOK"))
    return (
        event_time(calls, "created_at", delay).groupBy(F.window("created_at", window).alias("w")).agg(F.count(F.lit(1)).alias("model_calls"))
        .filter(F.col("model_calls") > limit).select(F.col("w.start").alias("hour_window"), "model_calls")
    )


def stream_breaker(failures: DataFrame, threshold: int = 10, loops: int = 3, attempts: int = 3, slide: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Trailing counts of escalations (1 hour) and fix loops (2 hours) per window end that call for a stop.

    Both counts come from one 2-hour sliding window: the escalations of its last hour
    are those after its middle.
    """
    w = F.window("detected_at", "2 hours", slide).alias("w")
    ts = event_time(failures, "detected_at", delay)
    rows = ts.select(w, "detected_at", "status", "fix_attempts")
    half = F.col("w.end") - F.expr("INTERVAL 1 HOUR")
    return (
        rows.groupBy("w")
        .agg(
            F.count_if((F.col("status") == "ESCALATED") & (F.col("detected_at") >= half)).alias("recent_escalations"),
            F.count_if((F.col("fix_attempts") >= attempts) & (F.col("status") != "RESOLVED")).alias("recent_fix_loops"),
        )
        .filter((F.col("recent_escalations") > threshold) | (F.col("recent_fix_loops") > loops))
        .select(F.col("w.end").alias("window_end"), "recent_escalations", "recent_fix_loops")
    )


def stream_freshness(history: DataFrame, target_lag: str = "8 hours", k: int = 3, delay: str = "1 hour", lags: DataFrame | None = None) -> DataFrame:
    """Objects that stayed silent for longer than k times their target lag: a closed session is the alert.

    `lags` holds (object_name, target_lag_seconds), one row per object; `target_lag` is for those that it lacks. Each
    row brings its object's gap, so a session ends by the lag of its own object.
    """
    amount, unit = target_lag.split(" ", 1)
    gap, rows = F.lit(f"{int(amount) * k} {unit}"), event_time(history, delay=delay)
    if lags is not None:
        rows = rows.join(lags.select("object_name", (F.col("target_lag_seconds") * k).cast("bigint").alias("_gap")), "object_name", "left")
        gap = F.coalesce(F.concat(F.col("_gap").cast("string"), F.lit(" seconds")), gap)
    return (
        rows.groupBy(F.session_window("ts", gap).alias("s"), "object_name").agg(F.count(F.lit(1)).alias("runs"))
        .select("object_name", "runs", F.col("s.start").alias("first_seen"), F.col("s.end").alias("silent_from"))
    )


def stream_run_pairs(starts: DataFrame, ends: DataFrame, bound: str = "24 hours", delay: str = "1 hour") -> DataFrame:
    """Starts paired with their ends; a start without one after the bound comes out as open."""
    s = event_time(starts.select("run_id", "start_ts"), "start_ts", delay).alias("s")
    e = event_time(ends.select(F.col("run_id").alias("end_id"), "end_ts"), "end_ts", delay).alias("e")
    near = F.expr(f"run_id = end_id AND end_ts >= start_ts AND end_ts <= start_ts + INTERVAL {bound}")
    return s.join(e, near, "left_outer").select(
        "run_id", "start_ts", "end_ts", F.when(F.col("end_ts").isNull(), "open").otherwise("completed").alias("status")
    )


def stream_error_rate(events: DataFrame, is_error: Column, window: str = "1 day", delay: str = "1 hour", by: Sequence[str] = (), unique: Sequence[str] = ()) -> DataFrame:
    """Requests, errors and their share per window of event time, and per value of the columns `by`.

    Rows later than the watermark are left out. If `unique` names the columns that tell rows apart, repeated rows count
    once and late ones are dropped row by row, so that `run_counted` gives their exact number.
    """
    rows = event_time(events, delay=delay).withColumn("_bad", is_error)
    if unique:
        rows = rows.dropDuplicatesWithinWatermark(list(unique))
    counted = rows.groupBy(F.window("ts", window).alias("w"), *by).agg(F.count(F.lit(1)).alias("total_requests"), F.count_if("_bad").alias("error_count"))
    share = [percent(F.col("error_count"), F.col("total_requests")).alias("error_pct")] if by else []
    return counted.select(F.col("w.start").alias("window_start"), *by, "total_requests", "error_count", *share)


def stream_triage(objects: DataFrame, known: DataFrame) -> DataFrame:
    """New objects scored as they arrive against the table of known ones.

    objects: full_name, schema_name, table_name, is_transient, queries, users, row_count, column_count;
    known: full_name, previous_rows, previous_columns, quality_score.
    """
    joined = objects.join(known.withColumn("is_known", F.lit(True)), "full_name", "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))
    return triage(joined)


CATALOG = "database_name string, schema_name string, table_name string, schema_hash string, action string, version bigint, part string"


def catalog_delta_writer(
    spark: SparkSession, target_path: str, classes: DataFrame | None = None, newest: str | None = None
) -> Callable[[DataFrame, int], None]:
    """Batch function that upserts each catalog snapshot into a table kept by database, for `catalog_table` to read.

    A batch writes the databases it holds, as they are after it, and then a manifest row for each; other databases stay
    where an earlier batch wrote them. Files without a manifest count for nothing, and a batch that runs again reads only
    what came before it and overwrites its own files, so it leaves the same result. Of rows with one key in a batch the
    one with the greatest `newest` counts, then the greatest hash. With `classes` (class_name, source_table) a batch also
    writes the tables of a class whose hash changed to the folder `drift`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        latest = F.max_by("schema_hash", F.struct(*([newest] if newest else []), "schema_hash"))
        rows = batch.groupBy(*TABLE_KEY).agg(latest.alias("schema_hash")).withColumn("part", _part()).persist()
        try:
            if rows.isEmpty():
                return
            own = f"version={batch_id:012d}"
            previous = catalog_table(spark, target_path, before=batch_id)
            if previous is None:
                merged = delta_upsert(rows, rows, "FULL")
            else:
                previous = previous.withColumn("part", _part()).join(rows.select("part").distinct(), "part", "left_semi")
                merged = delta_upsert(previous, rows)
            merged.withColumn("part", _part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{target_path}/data/{own}")
            if classes is not None and previous is not None:
                ontology_drift(previous, rows, classes).write.mode("overwrite").parquet(f"{target_path}/drift/{own}")
            rows.select("part").distinct().write.mode("overwrite").parquet(f"{target_path}/manifest/{own}")
        finally:
            rows.unpersist()

    return write


def _part() -> Column:
    """Folder of a database; its name may be null or empty, which a folder cannot tell apart."""
    return F.coalesce(F.concat(F.lit("d"), F.md5("database_name")), F.lit("none"))


def catalog_table(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Table that the batches before one (or all) left, or None if there was none.

    The action is what the last batch did to a row, so rows of databases that it did not hold are kept ones.
    """
    try:
        manifest = spark.read.schema("part string, version bigint").parquet(f"{path}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    valid = (manifest if before is None else manifest.filter(F.col("version") < before)).groupBy("part").agg(F.max("version").alias("version"))
    if valid.isEmpty():
        return None
    last = valid.agg(F.max("version").alias("v")).scalar()
    rows = spark.read.schema(CATALOG).parquet(f"{path}/data").join(valid, ["part", "version"], "left_semi")
    return rows.withColumn("action", F.when(F.col("version") == last, F.col("action")).otherwise("keep")).select(*TABLE_KEY, "schema_hash", "action")


def run_available(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Process all input there is, write it as parquet, and stop."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_counted(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """`run_available`, and a row per batch: batch_id, input_rows, late_rows.

    late_rows are those that the first stateful step found behind the watermark and dropped; later steps drop none
    besides. A batch of every file needs maxFilesPerTrigger = 1 at the source.
    """
    spark, kept = stream.sparkSession, "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(kept)
    spark.conf.set(kept, str(1 << 20))  # a few hundred bytes a batch, until the query ends
    try:
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(kept, before)
    rows = [(p.batchId, p.numInputRows, sum(o.numRowsDroppedByWatermark for o in p.stateOperators)) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch_id bigint, input_rows bigint, late_rows bigint").groupBy("batch_id").agg(F.max("input_rows").alias("input_rows"), F.max("late_rows").alias("late_rows"))
