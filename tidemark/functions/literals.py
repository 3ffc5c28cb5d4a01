"""Which of many patterns fit which of many texts, without comparing each with each.

Each pattern has strings that every text it fits must hold. The rarest three letters of them (counted over the texts) are
its key, and only texts with these three letters are tried. Patterns without such strings are tried on all texts, in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable

BLOCK = 64  # patterns without a key that one copy of the texts is tried with
_BREAK = "\u0000"


def required_literals(pattern: Column) -> Column:
    """Strings that every match of a regular expression holds; none where that is not plain to see.

    Escapes, character classes, groups (with all they hold) and letters that need not be there end a string. Patterns
    with alternatives outside of groups, inline flags, quoting or unbalanced brackets have none.
    """
    p = F.regexp_replace(pattern, r"(?s)\\.", _BREAK)
    p = F.regexp_replace(p, r"\[\^?\]?[^\[\]]*\]", _BREAK)
    for _ in range(4):  # groups from the inside out; deeper ones leave a bracket and so no strings
        p = F.regexp_replace(p, r"\([^()]*\)", _BREAK)
    p = F.regexp_replace(p, r"(?s).[?*][?+]?|.\{[^{}]*\}[?+]?", _BREAK)
    unsure = pattern.rlike(r"\(\?[a-zA-Z-]|\\Q") | p.rlike(r"[|()\[\]{}]")
    parts = F.filter(F.split(p, "[\u0000.^$+]"), lambda x: F.length(x) >= 3)
    return F.when(~unsure, parts).otherwise(F.array().cast("array<string>"))


def trigrams(text: Column) -> Column:
    """Distinct three letters in a row of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), 1))


def fitting_pairs(texts: DataFrame, text: str, rules: DataFrame, rule: str, literals: Column, fits: Column, folded: Column | None = None) -> DataFrame:
    """Pairs (text, rule) for which `fits` holds, over distinct values that are not null.

    literals: array of strings, over the rule's column; a text that fits holds them all, in itself or in `folded` (over
    the text's column) if that is given.
    """
    texts = texts.select(text).where(F.col(text).isNotNull()).distinct()
    rules = durable(rules.select(rule).where(F.col(rule).isNotNull()).distinct().withColumn("_grams", F.flatten(F.transform(literals, trigrams))))
    keyed = rules.select(rule, F.explode("_grams").alias("_gram")).distinct()
    held = texts.select(text, F.explode(trigrams(F.col(text) if folded is None else folded)).alias("_gram"))
    held = durable(held.join(keyed.select("_gram").distinct(), "_gram", "left_semi"))
    common = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_df"))
    rarest = keyed.join(common, "_gram", "left").groupBy(rule).agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("_gram").alias("gram"))).alias("_b"))
    found = held.join(rarest.select(rule, F.col("_b.gram").alias("_gram")), "_gram").where(fits).select(text, rule)
    rest = rules.where(F.size("_grams") == 0).select(rule)
    blocks = -(-rest.count() // BLOCK)
    if not blocks:
        return found
    copies = texts.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = rest.withColumn("_block", F.pmod(F.xxhash64(rule), F.lit(blocks)).cast("int"))
    return found.unionByName(copies.join(dealt, "_block").where(fits).select(text, rule))
