"""Token counts of a corpus as an exact histogram of encoded lengths.

Documents are counted per length; sums from the longest length downwards then answer, for every context limit, how many
documents exceed it and how many tokens remain when texts are cut there. Sums are taken in two steps (ranges of lengths,
then lengths within a range), so no task sees the whole histogram.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, keyed, stored
from tidemark.llm.vocab import byte_bpe

RANGE = 1024


def token_counts(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens. Null and empty texts have none; repeated rows fold into one (`keyed`)."""

    def rows(batches):
        table = byte_bpe(path)
        for batch in batches:
            for block in blocks([batch]):
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(table.encode(block.column("text"))[1])], ["doc_id", "n_tokens"])

    return keyed(documents).mapInArrow(rows, "doc_id long, n_tokens long")


def length_histogram(counts: DataFrame) -> DataFrame:
    """A row per length that occurs, taken as a context limit.

    n_tokens (the limit), n_docs of that length, docs_over and docs_up_to, tokens_kept (total if every text is cut at the
    limit), tokens_lost, quantile (share of documents up to the limit). An empty table gives no row.
    """
    exact = counts.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("range", F.floor(F.col("n_tokens") / RANGE))
    exact = stored(exact.withColumn("tokens", F.col("n_docs") * F.col("n_tokens")))  # texts are encoded once
    ranges = exact.groupBy("range").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("all_tokens"))
    above = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per 1,024 lengths
    whole = Window.partitionBy()
    zero = F.lit(0).cast("long")
    ranges = ranges.select("range", F.coalesce(F.sum("docs").over(above), zero).alias("docs_above"), F.coalesce(F.sum("all_tokens").over(above), zero).alias("tokens_above"), F.sum("docs").over(whole).alias("total_docs"), F.sum("all_tokens").over(whole).alias("total_tokens"))
    within = Window.partitionBy("range").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = exact.join(ranges, "range").withColumn("docs_over", F.col("docs_above") + F.coalesce(F.sum("n_docs").over(within), zero))
    rows = rows.withColumn("tokens_over", F.col("tokens_above") + F.coalesce(F.sum("tokens").over(within), zero))
    lost = F.col("tokens_over") - F.col("docs_over") * F.col("n_tokens")
    up_to = F.col("total_docs") - F.col("docs_over")
    return rows.select("n_tokens", "n_docs", "docs_over", up_to.alias("docs_up_to"), (F.col("total_tokens") - lost).alias("tokens_kept"), lost.alias("tokens_lost"), (up_to / F.col("total_docs")).alias("quantile"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Figures at any limits, whether such a length occurs or not: limit, docs_over, tokens_kept, tokens_lost.

    The limits are a short list given by the caller; one pass adds up all of them.
    """
    total = F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0))
    figures = []
    for limit in sorted(set(limits)):
        over = F.col("n_tokens") > limit
        lost = F.coalesce(F.sum(F.when(over, F.col("n_docs") * (F.col("n_tokens") - limit))), F.lit(0))
        figures.append(F.struct(F.lit(limit).cast("long").alias("limit"), F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_over"), (total - lost).alias("tokens_kept"), lost.alias("tokens_lost")))
    return histogram.agg(F.array(*figures).alias("rows")).select(F.inline("rows"))


def quantile_length(histogram: DataFrame, share: float) -> DataFrame:
    """Smallest length that at least `share` of the documents do not exceed."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))
