"""Walks over dependency graphs: closure, root causes, dependents, order."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import as_large
from tidemark.session import durable


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, cut_every: int = 4, paths: bool = True) -> DataFrame:
    """Nodes reachable from each start along (src, dst) edges, with depth and first path (null without `paths`).

    Breadth first: a node already reached from a start is dropped, so cycles end
    and the depth is the smallest one; among equal paths the first in text order
    is kept. Every round is one join; lineage is cut every few rounds. Rounds go on
    until nothing new is reached; `max_depth` stops them earlier. No round sends
    a side through the driver: over all rounds that would add up to the graph.
    """
    e = durable(edges.select("src", "dst").distinct())
    frontier = starts.select(F.col("node").alias("start")).distinct().select(
        "start", F.col("start").alias("node"), F.when(F.lit(paths), F.col("start").cast("string")).alias("path"), F.lit(0).cast("bigint").alias("depth")
    )
    seen = frontier
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = (
            frontier.join(as_large(e), F.col("node") == F.col("src"))
            .groupBy("start", "dst")
            .agg((F.min(F.concat_ws(">", "path", F.col("dst").cast("string"))) if paths else F.lit(None).cast("string")).alias("path"))
            .select("start", F.col("dst").alias("node"), "path", F.lit(depth).cast("bigint").alias("depth"))
        )
        frontier = durable(step.join(as_large(seen.select("start", "node")), ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % cut_every == 0:
            seen = durable(seen)
    return seen


def root_cause(failures: DataFrame, edges: DataFrame, upstream_pattern: str, hours: int = 2) -> DataFrame:
    """Nearest ancestor that failed by itself shortly before an upstream failure.

    `edges` holds (child, parent). The walk starts from distinct nodes, not from
    single failures; the two are joined afterwards within the time window.
    """
    up = F.col("error_message").rlike(upstream_pattern)
    blamed = failures.filter(up).select("failure_id", F.col("node").alias("start"), F.col("detected_at").alias("_at"))
    own = failures.filter(~up).select(F.col("node").alias("cause"), F.col("detected_at").alias("_cause_at"))
    walk = reachable(edges.select(F.col("child").alias("src"), F.col("parent").alias("dst")), blamed.select(F.col("start").alias("node")))
    ancestors = walk.filter("depth > 0").select("start", F.col("node").alias("cause"), "depth", "path")
    near = (F.col("_cause_at") <= F.col("_at")) & (F.col("_cause_at") >= F.col("_at") - F.expr(f"INTERVAL '{hours}' HOUR"))
    # an hour bucket joins the two sides by equality; the exact window is checked after it
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (hours * 3_600_000_000))
    slots = blamed.select("failure_id", "start", "_at", F.explode(F.array(bucket("_at"), bucket("_at") - 1)).alias("_slot"))
    hits = (
        slots.join(as_large(ancestors), "start")
        .join(as_large(own.withColumn("_slot", bucket("_cause_at"))), ["cause", "_slot"])
        .filter(near)
        .groupBy("failure_id")
        .agg(F.min(F.struct("depth", "cause", "path")).alias("_b"))
    )
    return hits.select("failure_id", F.col("_b.cause").alias("root_cause"), F.col("_b.depth").alias("depth"), F.col("_b.path").alias("path"))


def fold_leaves(edges: DataFrame, weights: DataFrame, sums: list[str], least_share: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Weights of leaves with a single parent, added to that parent as long as there are such: what is left, what was folded.

    `weights` holds a row per node, with the columns `sums`. Whatever reaches the parent reaches the leaf, and nothing else
    does but the leaf, so sums over reachable nodes stay the same. A folded node has all that it reaches in its own sums.
    Folding stops once a round takes less than `least_share` of the nodes, so that a long chain costs no round a node.
    """
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.min("src").alias("parent")).filter("_n = 1").drop("_n")
    out_of = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    left = weights.join(as_large(into), "node", "left").join(as_large(out_of), "node", "left")
    left = durable(left.withColumn("children", F.coalesce("children", F.lit(0))))
    is_leaf = (F.col("children") == 0) & F.col("parent").isNotNull()
    folded, n = left.limit(0), left.count()
    while True:
        leaves = left.filter(is_leaf)
        taken = leaves.count()
        folded = folded.unionByName(leaves)
        given = leaves.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_gone"), *[F.sum(c).alias(f"_{c}") for c in sums])
        rest = left.filter(~is_leaf).join(as_large(given), "node", "left")
        plus = {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in sums}
        left = durable(rest.withColumns({**plus, "children": F.col("children") - F.coalesce("_gone", F.lit(0))}).select(left.columns))
        n -= taken
        if taken <= least_share * n:
            return left.drop("parent", "children"), folded.drop("parent", "children")


def downstream_status(nodes: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """Whether all dependents of each node are healthy; skipped counts as healthy for tasks.

    `states` holds (node, object_type, state), one row per node. Dependents with a single parent are counted at that parent
    (`fold_leaves`); pairs of start and node are kept for the rest of the graph only, and without paths.
    """
    ok = (F.col("state") == "SUCCEEDED") | ((F.col("state") == "SKIPPED") & (F.col("object_type") == "TASK"))
    known = states.groupBy("node").agg(F.count(F.lit(1)).alias("own"), F.count_if(~F.coalesce(ok, F.lit(True))).alias("own_bad"))
    e = durable(edges.select(F.col("parent").alias("src"), F.col("child").alias("dst")).filter("src <> dst").distinct())
    each = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct().join(as_large(known), "node", "left")
    own, own_bad = F.coalesce("own", F.lit(1)), F.coalesce("own_bad", F.lit(0))
    left, folded = fold_leaves(e, each.select("node", own.alias("own"), own_bad.alias("own_bad"), own.alias("n"), own_bad.alias("bad")), ["n", "bad"])
    starts = nodes.select("node").distinct()
    core = e.join(as_large(left.select(F.col("node").alias("dst"))), "dst", "left_semi")
    walk = reachable(core, starts.join(as_large(left), "node", "left_semi"), paths=False)
    sums = walk.join(as_large(left.select("node", "n", "bad")), "node").groupBy(F.col("start").alias("node")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    with_own = sums.join(as_large(left.select("node", "own", "own_bad")), "node").unionByName(folded)
    per = with_own.select("node", (F.col("n") - F.col("own")).alias("dependents"), (F.col("bad") - F.col("own_bad")).alias("unhealthy"))
    return (
        starts.join(as_large(per), "node", "left").fillna(0, ["dependents", "unhealthy"])
        .select("node", "dependents", "unhealthy", F.when(F.col("unhealthy") == 0, "RESOLVED").otherwise("ESCALATED").alias("outcome"))
    )


def spread_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Least label that reaches each node along (src, dst) edges: node, depth, label.

    `labels` holds (node, label), at depth 0. Labels are ordered by depth, then by value, and a node keeps the least of
    all that reach it. A node takes its label in the round of its depth, so it sends it on once: all rounds together read
    each edge once and keep one row a node, however many labels there are. Rounds go on until nothing new is reached.
    """
    frontier = durable(labels.groupBy("node").agg(F.min("label").alias("label")).select("node", F.lit(0).cast("bigint").alias("depth"), "label"))
    seen = frontier
    for depth in count(1):
        met = frontier.join(as_large(edges.select(F.col("src").alias("node"), "dst")), "node").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("label"))
        met = met.select("node", F.lit(depth).cast("bigint").alias("depth"), "label")
        frontier = durable(met.join(as_large(seen.select("node")), "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def resolve_dependencies(rules: DataFrame, depends: DataFrame) -> DataFrame:
    """Rules that stay after dropping those with a missing dependency, direct or not.

    `rules` holds (node), `depends` holds (child, parent). A cycle drops nothing;
    the status tells the first missing name of the nearest rule that lacks one.
    """
    known = as_large(rules.select(F.col("node").alias("parent")))
    broken = depends.join(known, "parent", "left_anti").select(F.col("child").alias("node"), F.col("parent").alias("label"))
    up = depends.join(known, "parent", "left_semi").select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    dropped = spread_labels(durable(up.distinct()), broken)
    return rules.join(as_large(dropped), "node", "left").select(
        "node",
        F.col("depth").isNull().alias("is_kept"),
        F.col("label").alias("missing"),
        F.when(F.col("depth") == 0, "MISSING_DEPENDENCY").when(F.col("depth") > 0, "DEPENDS_ON_DROPPED").otherwise("OK").alias("status"),
    )


def load_order(rules: DataFrame, depends: DataFrame) -> DataFrame:
    """Level of each rule: one above its deepest dependency; rules on a cycle get none.

    Each rule counts the dependencies it still waits for. A round settles the rules that wait for none and takes them off
    the counts of those that depend on them: one checkpoint, each edge used once.
    """
    nodes = rules.select("node").distinct()
    edges = durable(depends.join(as_large(nodes.withColumnRenamed("node", "parent")), "parent", "left_semi").select("child", "parent").distinct())
    waits = edges.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("waits"))
    state = durable(nodes.join(as_large(waits), "node", "left").select("node", F.coalesce("waits", F.lit(0)).alias("waits")))
    done = None
    for level in count():
        ready = state.filter("waits = 0")
        if ready.isEmpty():
            rest = state.select("node", F.lit(None).cast("bigint").alias("level"))
            return rest if done is None else done.unionByName(rest)
        settled = ready.select("node", F.lit(level).cast("bigint").alias("level"))
        done = settled if done is None else done.unionByName(settled)
        fewer = edges.join(as_large(ready.select(F.col("node").alias("parent"))), "parent").groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("fewer"))
        left = state.filter("waits > 0").join(as_large(fewer), "node", "left")
        state = durable(left.select("node", (F.col("waits") - F.coalesce("fewer", F.lit(0))).alias("waits")))
