"""Selection of rules for a request: matching and token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TIERS = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def match_rules(requests: DataFrame, rules: DataFrame, foundation: str) -> DataFrame:
    """Rules of each request with the reason: directory, file name, extension or keyword.

    requests: request_id, text; rules: rule, kind (directory, file, extension, keyword),
    token in lower case. The foundation rule is always included, and an extension
    without a rule is reported. Tokens meet rules by equality.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[\s,;:()\"']+"), lambda w: w != ""))
    token = requests.select("request_id", F.explode(words).alias("_w"))
    w = F.rtrim(F.regexp_replace("_w", r"[.!?]+$", ""))
    base = F.element_at(F.split(w, "/"), -1)
    kinds = F.array(
        F.struct(F.lit("directory").alias("kind"), F.concat(F.get(F.split(w, "/"), F.lit(0)), F.lit("/")).alias("token"), w.contains("/").alias("use")),
        F.struct(F.lit("file").alias("kind"), base.alias("token"), F.lit(True).alias("use")),
        F.struct(F.lit("extension").alias("kind"), F.regexp_extract(base, r"(\.[a-z0-9]+)$", 1).alias("token"), base.rlike(r"\.[a-z0-9]+$").alias("use")),
        F.struct(F.lit("keyword").alias("kind"), w.alias("token"), F.lit(True).alias("use")),
    )
    asked = token.select("request_id", F.explode(kinds).alias("k")).filter("k.use").select("request_id", "k.kind", "k.token").distinct()
    found = asked.join(rules, ["kind", "token"])
    order = F.when(F.col("kind") == "directory", 0).when(F.col("kind") == "file", 1).when(F.col("kind") == "extension", 2).otherwise(3)
    best = found.groupBy("request_id", "rule").agg(F.min(F.struct(order.alias("o"), "kind", "token")).alias("_b")).select(
        "request_id", "rule", F.concat(F.lit("("), F.when(F.col("_b.kind") == "extension", "file extension").otherwise(F.col("_b.kind")), F.lit(": "), F.col("_b.token"), F.lit(")")).alias("reason")
    )
    base_rows = requests.select("request_id", F.lit(foundation).alias("rule"), F.lit("(foundation)").alias("reason"))
    known = rules.filter("kind = 'extension'").select("token").distinct()
    unknown = asked.filter("kind = 'extension'").join(known, "token", "left_anti").select(
        "request_id", F.lit(None).cast("string").alias("rule"), F.concat(F.lit("No domain rule for "), F.col("token")).alias("reason")
    )
    return base_rows.unionByName(best).unionByName(unknown)


def budget_select(selected: DataFrame, warn_at: int = 15_000, limit: int = 20_000) -> DataFrame:
    """Which rules of a request load within the token budget.

    Needs request_id, rule, tokens, tier, is_related. Within the limit all load; above
    it low ones are deferred, then unrelated medium ones, then high ones, until the
    rest fits; critical and related medium ones always load. A request selects from
    the rule index, so its window is small.
    """
    per = Window.partitionBy("request_id")
    tier = F.col("tier")
    kept_order = F.when(tier == "critical", 0).when((tier == "medium") & F.col("is_related"), 1).when(tier == "high", 2).when(tier == "medium", 3).otherwise(4)
    running = per.orderBy("_o", "rule").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col("total_tokens")
    always = F.col("_o") <= 1
    return (
        selected.withColumn("_o", kept_order)
        .withColumn("total_tokens", F.sum("tokens").over(per))
        .withColumn("_run", F.sum("tokens").over(running))
        .select(
            "request_id", "rule", "tokens", "total_tokens",
            F.when(total <= limit, "LOAD").when(always, "LOAD").when(tier == "low", "DEFER").when(F.col("_run") <= limit, "LOAD").otherwise("DEFER").alias("decision"),
            F.when(total > limit, "OVER").when(total > warn_at, "WARNING").otherwise("OK").alias("budget"),
        )
    )
