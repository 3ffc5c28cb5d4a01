"""Graph views over relational tables: nodes, edges, classes, statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_nodes(table: DataFrame, node_type: str, key: str, columns: Mapping[str, str]) -> DataFrame:
    """Nodes of one class: id, type and renamed columns."""
    return table.select(F.concat_ws(":", F.lit(node_type), F.col(key).cast("string")).alias("node_id"), F.lit(node_type).alias("node_type"), *[F.col(c).alias(a) for c, a in columns.items()])


def relation_edges(left: DataFrame, right: DataFrame, on: Column, relation: str, left_id: str = "l.node_id", right_id: str = "r.node_id") -> DataFrame:
    """Edges between two node relations, joined as l and r."""
    return left.alias("l").join(right.alias("r"), on).select(F.col(left_id).alias("src_id"), F.col(right_id).alias("dst_id"), F.lit(relation).alias("relation"))


def abstract_class(members: Mapping[str, DataFrame], abstract: str) -> DataFrame:
    """All nodes of several classes under one abstract class."""
    out = None
    for _, df in sorted(members.items()):
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.withColumn("abstract_class", F.lit(abstract))


def generic_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with all their other columns as JSON properties."""
    rest = [c for c in nodes.columns if c not in ("node_id", "node_type")]
    return nodes.select("node_id", "node_type", F.to_json(F.struct(*rest)).alias("properties"))


def generic_edges(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """Edges with a content-based id and a weight; equal edges become one, their weights summed."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return edges.groupBy("src_id", "dst_id", "relation").agg(F.sum(w).alias("weight")).withColumn("edge_id", F.sha2(F.concat_ws("|", "src_id", "relation", "dst_id"), 256))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals of a graph as name and value rows."""
    n = nodes.agg(F.count(F.lit(1)).alias("total_nodes"), F.count_distinct("node_type").alias("total_classes"))
    e = edges.agg(F.count(F.lit(1)).alias("total_edges"), F.count_distinct("relation").alias("total_relations"))
    return n.unpivot([], n.columns, "stat", "value").unionByName(e.unpivot([], e.columns, "stat", "value"))


def view_health(nodes: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Rows per expected class; an empty class is flagged."""
    wanted = nodes.sparkSession.createDataFrame([(c,) for c in classes], "node_type string")
    counts = nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("row_count"))
    return wanted.join(counts, "node_type", "left").fillna(0, ["row_count"]).withColumn("status", F.when(F.col("row_count") > 0, "OK").otherwise("EMPTY"))


def intake_gate(domains: DataFrame) -> DataFrame:
    """Five readiness checks per domain; needs concept_count, has_relations, has_config, index_status, status."""
    checks = {
        "concepts": F.col("concept_count") >= 3, "relations": F.col("has_relations"), "config": F.col("has_config"),
        "index": F.coalesce(F.col("index_status") == "ACTIVE", F.lit(False)), "status": F.col("status").isin("ENRICHED", "ACTIVE"),
    }
    failed = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])), ",")
    return domains.select("domain", failed.alias("failed_checks")).withColumn("gate", F.when(F.col("failed_checks") == "", "PASS").otherwise("STOP"))
