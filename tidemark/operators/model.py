"""Training and scoring of a classifier with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import rounded


def encode(df: DataFrame, rules: Mapping[str, Sequence[tuple[Sequence[str], int]]], required: Sequence[str] = ()) -> DataFrame:
    """Codes of text columns by ordered rules, 0 when none fits; rows with nulls are dropped."""
    kept = df.dropna(subset=[*rules, *required])
    for column, pairs in rules.items():
        code = None
        for values, number in pairs:
            hit = F.col(column).isin(*values)
            code = F.when(hit, number) if code is None else code.when(hit, number)
        kept = kept.withColumn(f"{column}_code", (code.otherwise(0) if code is not None else F.lit(0)).cast("bigint"))
    return kept


def in_test(key: str | Column, share: float = 0.2, seed: int = 42) -> Column:
    """Whether a row belongs to the test part: the same for the same key and seed, whatever the partitions."""
    k = F.col(key) if isinstance(key, str) else key
    bucket = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), k.cast("string"))), 1, 8), 16, 10).cast("bigint") % 10_000
    return bucket < int(share * 10_000)


def split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows."""
    test = in_test(key, share, seed)
    return df.filter(~test), df.filter(test)


def train(df: DataFrame, features: Sequence[str], label: str, rounds: int = 100, depth: int = 5, rate: float = 0.1, seed: int = 42) -> PipelineModel:
    """Boosted trees over numeric columns. A null or NaN is zero, with an indicator as a feature of its own, so every row is scored."""
    filled = [f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), NULL), 0D) AS `_filled_{c}`" for c in features]
    missing = [f"CAST(`{c}` IS NULL OR isnan(CAST(`{c}` AS DOUBLE)) AS DOUBLE) AS `_missing_{c}`" for c in features]
    fill = SQLTransformer(statement=f"SELECT *, {', '.join(filled + missing)} FROM __THIS__")
    assembler = VectorAssembler(inputCols=[f"_filled_{c}" for c in features] + [f"_missing_{c}" for c in features], outputCol="features", handleInvalid="error")
    trees = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)
    return Pipeline(stages=[fill, assembler, trees]).fit(df.withColumn(label, F.col(label).cast("double")))


def score(df: DataFrame, model: PipelineModel, name: str = "predicted") -> DataFrame:
    """Rows with the prediction of the model under a stable name."""
    keep = [c for c in df.columns]
    return model.transform(df).select(*keep, F.col("prediction").cast("bigint").alias(name))


def classification_metrics(scored: DataFrame, label: str, predicted: str = "predicted") -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class, from the four counts."""
    y, p = F.col(label), F.col(predicted)
    c = scored.agg(
        F.count(F.lit(1)).alias("n"), F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, n = F.col("tp"), F.col("fp"), F.col("fn"), F.col("n")
    return c.select(
        "n", "tp", "fp", "fn", rounded(ratio(n - fp - fn, n), 6).alias("accuracy"), rounded(ratio(tp, tp + fp), 6).alias("precision"), rounded(ratio(tp, tp + fn), 6).alias("recall"),
        rounded(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
    )
