"""Typed events of agent transcripts, and texts of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.exact import head

DONE = "[DONE]"


def typed_lines(lines: DataFrame) -> DataFrame:
    """Data lines with the event they belong to, up to the done marker of their run.

    lines: run_id, line_no, line. A transcript is one reply, so its lines are few; they
    are ordered within the run only.
    """
    text = F.col("line")
    w = Window.partitionBy("run_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    event = F.last(F.when(text.startswith("event: "), F.trim(F.substring(text, F.lit(8), F.length(text)))), ignorenulls=True).over(w)
    payload = F.when(text.startswith("data: "), F.substring(text, F.lit(7), F.length(text)))
    ended = F.max(F.when(F.trim(payload) == DONE, 1).otherwise(0)).over(w)
    return (
        lines.withColumns({"event": event, "payload": payload, "_end": ended})
        .filter((F.col("_end") == 0) & F.col("payload").isNotNull())
        .select("run_id", "line_no", "event", F.try_parse_json("payload").alias("v"))
        .filter(F.col("v").isNotNull())
    )


def _text(path: str) -> Column:
    return F.try_variant_get("v", path, "string")


def tool_uses(events: DataFrame) -> DataFrame:
    """Tools that a run used, numbered in order."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("line_no"))
    return events.filter((F.col("event") == "response.tool_use") & (F.coalesce(_text("$.name"), F.lit("")) != "")).select(
        "run_id", place.cast("bigint").alias("sequence"), _text("$.name").alias("tool_name"), _text("$.type").alias("tool_type"), _text("$.tool_use_id").alias("tool_use_id")
    )


def _results(events: DataFrame, keep: int | None) -> DataFrame:
    """Results of tools as analyst, search or other, with their first items as an array of texts."""
    items = F.from_json(F.to_json("v"), "content array<string>")["content"]
    found = events.filter(F.col("event") == "response.tool_result").select("run_id", "line_no", F.explode(items).alias("i"))
    rows = found.withColumn("j", F.get_json_object("i", "$.json")).filter("j is not null")
    j = F.col("j")
    sql, found = F.get_json_object(j, "$.sql"), F.get_json_object(j, "$.search_results")
    first = lambda x: head(F.from_json(x, "array<string>"), keep)
    data = F.when(sql.isNotNull(), first(F.get_json_object(j, "$.result_set.data"))).when(found.isNotNull(), first(found)).otherwise(F.array(j))
    return rows.select(
        "run_id", "line_no", F.when(sql.isNotNull(), "analyst").when(found.isNotNull(), "search").otherwise("other").alias("result_type"), sql.alias("sql"), data.alias("items")
    )


def tool_results(events: DataFrame, keep: int | None = None) -> DataFrame:
    """Results of tools as analyst, search or other, with the number of their items, `keep` at most (5 is usual)."""
    return _results(events, keep).select("run_id", "line_no", "result_type", "sql", F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("items_kept"))


def tool_result_items(events: DataFrame, keep: int | None = 5) -> DataFrame:
    """Items of tool results, one row each, the first `keep` of a result; None keeps all."""
    return _results(events, keep).select("run_id", "line_no", "result_type", F.posexplode("items").alias("_p", "item")).select(
        "run_id", "line_no", "result_type", (F.col("_p") + 1).cast("bigint").alias("position"), "item"
    )


def answers(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Answer of each run: its text pieces in order, or the first full text when no piece came."""
    piece = F.when((F.col("event") == "response.text.delta") & _text("$.text").isNotNull(), F.struct("line_no", _text("$.text").alias("t")))
    full = F.when((F.col("event") == "response.text") & (F.coalesce(_text("$.text"), F.lit("")) != ""), F.struct("line_no", _text("$.text").alias("t")))
    per = events.groupBy("run_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), "").alias("_d"), F.min(full).alias("_f")
    )
    return lines.select("run_id").distinct().join(per, "run_id", "left").select(
        "run_id", F.coalesce(F.nullif("_d", F.lit("")), F.col("_f.t"), F.lit("")).alias("answer")
    )


def batch_summary(runs: DataFrame, uses: DataFrame) -> DataFrame:
    """Runs that are fine, used no tool, or failed; `runs` holds run_id and error (or null)."""
    n = uses.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    j = runs.join(n, "run_id", "left")
    failed = F.col("error").isNotNull()
    return j.groupBy(F.when(failed, "ERROR").when(F.col("_n") > 0, "OK").otherwise("NO_TOOLS").alias("status")).agg(F.count(F.lit(1)).alias("run_count"))


def tool_counts(uses: DataFrame) -> DataFrame:
    """Calls per tool, most used first."""
    return uses.groupBy("tool_name").agg(F.count(F.lit(1)).alias("calls"))


def response_text(replies: DataFrame) -> DataFrame:
    """Text items of replies given as JSON, in order, with the run id; needs reply_id and body."""
    schema = "content array<struct<type:string,text:string>>, metadata struct<run_id:string>"
    b = F.from_json("body", schema)
    texts = F.transform(F.filter(b["content"], lambda x: x["type"] == "text"), lambda x: x["text"])
    return replies.select("reply_id", b["metadata"]["run_id"].alias("run_id"), F.coalesce(F.array_join(texts, "\n"), F.lit("")).alias("answer"))
