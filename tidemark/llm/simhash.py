"""Near duplicates by SimHash, linked by a self-join of the binary trie of fingerprints.

Two fingerprints that differ in at most three of 64 bits agree in one of four blocks. For each block the trie is built
with that block on top, and the join starts at the node pairs (n, n) below it (with a larger budget: for each choice of
blocks that must agree). Node pairs are followed together,
bits in which the branches differ are added up, and a pair is left as soon as they exceed the budget. Nodes too large for
one task are split into pairs of their grandchildren before, again only those within the budget.

A task returns a forest of its links, not all pairs: every link stays a path, so components are exact while a family of
n copies gives n - 1 rows.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, blocks, keyed, mixed, partitions, plain_id, stored

SPLIT_BITS = 8
NODE_LIMIT = 1_000_000  # fingerprints below one node that a task joins at once; larger nodes are split first
FRONTIER = 1 << 18


def simhash(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 (seed 42) of the n-word shingles of one text; fewer words are one shingle, none has none."""
    if len(words) < n:
        shingles, count = ([b" ".join(words)], 1) if words else ([], 0)
    else:
        shingles, count = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)), len(words) - n + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, count)


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, (np.cumsum(counts) - counts)[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * sums > counts[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of keyed documents. A bit is 1 if it is set in over half the shingles."""

    def rows(batches):
        for batch in batches:
            for block in blocks([batch], 1 << 19):
                hashes = [simhash(t.as_py().lower().split(), shingle) for t in block.column("text").cast(pa.binary())]
                counts = np.array([len(h) for h in hashes])
                prints = _majority(np.concatenate(hashes), counts)
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(rows, "doc_id long, fp long")


class Forest:
    """Union of links over places 0..n-1; the root of a tree is its smallest place."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.up[a], self.up[b]
            open_ = a != b
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while True:
                above = self.up[self.up]
                if np.array_equal(above, self.up):
                    break
                self.up = above


    def edges(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each value tied to the smallest of its tree, so that trees found in several orders of the bits give the same rows."""
        least = values.copy()
        np.minimum.at(least, self.up, values)
        root = least[self.up]
        tied = root != values
        return root[tied], values[tied]


def trie_join(a: np.ndarray, b: np.ndarray, pairs: np.ndarray, bit: int, budget: int, found) -> None:
    """Follows node pairs of two tries (sorted, distinct values) downwards. pairs: rows of a_from, a_to, b_from, b_to, spent.

    found gets the places of values that differ in `budget` bits at most; a pair of a trie with itself gives i < j.
    """
    same = a is b
    stack = [(pairs, bit)]
    while stack:
        p, bit = stack.pop()
        size = (p[:, 1] - p[:, 0]) * (p[:, 3] - p[:, 2])
        small = (size <= 32) | (bit < 0)
        if small.any():
            q, n = p[small], size[small]
            which = np.repeat(np.arange(len(q)), n)
            rank = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            width = (q[:, 3] - q[:, 2])[which]
            i, j = q[which, 0] + rank // width, q[which, 2] + rank % width
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            found(i[near], j[near])
            p = p[~small]
        if not len(p):
            continue
        if len(p) > FRONTIER:
            stack += [(half, bit) for half in np.array_split(p, 2)]
            continue
        unit, upper = np.uint64(1 << bit), np.uint64(2**64 - (2 << bit))
        mid_a = np.clip(np.searchsorted(a, (a[p[:, 0]] & upper) | unit), p[:, 0], p[:, 1])
        mid_b = np.clip(np.searchsorted(b, (b[p[:, 2]] & upper) | unit), p[:, 2], p[:, 3])
        a0, a1, b0, b1, spent = p.T
        own = same & (a0 == b0) & (a1 == b1)
        down = [
            np.stack([a0, mid_a, b0, mid_b, spent], 1),
            np.stack([mid_a, a1, mid_b, b1, spent], 1),
            np.stack([a0, mid_a, mid_b, b1, spent + 1], 1),
            np.stack([mid_a, a1, b0, mid_b, spent + 1], 1)[~own],
        ]
        down = np.concatenate(down)
        stack.append((down[(down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3]) & (down[:, 4] <= budget)], bit - 1))


class Layouts:
    """Orders of the bits with some blocks on top: values that differ in `budget` bits agree in `agree` of the blocks."""

    def __init__(self, budget: int, agree: int):
        n = budget + agree
        edges = [64 * i // n for i in range(n + 1)]
        self.all, self.tops = [], []
        for top in combinations(range(n), agree):
            blocks_, down = [], 64
            for k in [*top, *(k for k in range(n) if k not in top)]:
                size = edges[k + 1] - edges[k]
                down -= size
                blocks_.append((edges[k], down, (1 << size) - 1))  # from, to, mask
            self.all.append(blocks_)
            self.tops.append(sum(edges[k + 1] - edges[k] for k in top))

    def turn(self, x: np.ndarray, which: int, back: bool = False) -> np.ndarray:
        out = np.zeros_like(x)
        for from_, to, mask in self.all[which]:
            from_, to = (to, from_) if back else (from_, to)
            out |= ((x >> np.uint64(from_)) & np.uint64(mask)) << np.uint64(to)
        return out


def _ends(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return begin, np.append(begin[1:], len(values))


def links(prints: DataFrame, budget: int = 3, agree: int = 1, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Forest of the links among distinct fingerprints (column fp): rows a, b whose paths join what differs in <= budget bits.

    a is the smallest of b's tree. More blocks that agree mean smaller nodes and more orders of the bits: budget + agree over agree of them.
    """
    parts, layouts = partitions(prints.sparkSession), Layouts(budget, agree)

    def spread(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for k, top in enumerate(layouts.tops):
                turned = layouts.turn(fp, k)
                node = turned >> np.uint64(64 - top)
                bucket = (mixed(node + np.uint64(k << 48)) % np.uint64(parts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(fp), k, np.int32)), pa.array(node.view(np.int64)), pa.array(turned.view(np.int64))], ["bucket", "layout", "node", "fp"])

    def below(table: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
        layout, fp = table["layout"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
        for k in np.unique(layout).tolist():
            own = np.sort(fp[layout == k])
            begin, end = _ends(own >> np.uint64(64 - layouts.tops[k]))
            many = end - begin > 1
            begin, end = begin[many], end[many]
            forest = Forest(len(own))
            trie_join(own, own, np.stack([begin, end, begin, end, np.zeros_like(begin)], 1), 63 - layouts.tops[k], budget, forest.add)
            for to, x in zip(out, forest.edges(layouts.turn(own, k, back=True)), strict=True):
                to.append(x)
        return pa.table([pa.array(np.concatenate(x).view(np.int64)) for x in out], ["a", "b"])

    rows = prints.select("fp").mapInArrow(spread, "bucket int, layout int, node long, fp long")
    if prints.count() <= node_limit:  # then no node can be larger
        return rows.groupBy("bucket").applyInArrow(below, "a long, b long")
    large = stored(rows.groupBy("layout", "node").count().where(F.col("count") > node_limit).select("layout", "node"))
    small = rows.join(large, ["layout", "node"], "left_anti").groupBy("bucket").applyInArrow(below, "a long, b long")

    def split(batches):
        masks = np.array([m for m in range(1 << SPLIT_BITS) if m.bit_count() <= budget], np.uint64)
        for batch in batches:
            layout, fp = batch.column("layout").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            shift = np.array(layouts.tops)[layout].astype(np.uint64)
            child = (fp << shift) >> np.uint64(64 - SPLIT_BITS)
            for m in masks:
                other = child ^ m
                columns = (np.minimum(child, other).astype(np.int64), np.full(len(fp), m, np.int64), (child > other).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("layout"), batch.column("node"), *map(pa.array, columns), batch.column("fp")], ["layout", "node", "low", "mask", "side", "fp"])

    def across(table: pa.Table) -> pa.Table:
        k, mask = table["layout"][0].as_py(), table["mask"][0].as_py()
        side, fp = table["side"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
        a = np.sort(fp[side == 0])
        b = np.sort(fp[side == 1]) if mask else a
        values, shift = (np.concatenate([a, b]), len(a)) if mask else (a, 0)
        forest = Forest(len(values))
        if len(a) and len(b):
            trie_join(a, b, np.array([[0, len(a), 0, len(b), mask.bit_count()]]), 63 - layouts.tops[k] - SPLIT_BITS, budget, lambda i, j: forest.add(i, j + shift))
        return pa.table([pa.array(x.view(np.int64)) for x in forest.edges(layouts.turn(values, k, back=True))], ["a", "b"])

    pairs = rows.join(large, ["layout", "node"]).select("layout", "node", "fp").mapInArrow(split, "layout int, node long, low long, mask long, side long, fp long")
    return small.unionByName(pairs.groupBy("layout", "node", "low", "mask").applyInArrow(across, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest node reachable) of each node of the edges (a, b), by the smallest label of neighbours and of labels."""
    both = stored(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct().toDF("node", "other"))
    labels = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("seen"))
        new = labels.join(near, "node").select("node", F.least("root", "seen").alias("next"), F.col("root").alias("old"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("above"))
        new = stored(new.join(jump, "next").select("node", F.least("next", "above").alias("root"), "old"))
        moved = not new.where("root <> old").isEmpty()
        labels = new.select("node", "root")
        if not moved:
            return labels


def near_duplicates(documents: DataFrame, shingle: int = 3, budget: int = 3, agree: int = 1, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Component of near copies of each document: doc_id, fp (long), component_id (smallest doc_id reachable).

    Words are what lies between ASCII white space, A-Z lower-cased. A text with fewer words than a shingle is one
    shingle; one without words (null and empty too) has fingerprint zero and links like any other. Repeated rows fold
    into one (`keyed`); a null doc_id is a document of its own; an empty table gives an empty result.
    """
    prints = stored(fingerprints(keyed(documents), shingle))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    forest = links(distinct.select("fp"), budget, agree, node_limit)
    first = distinct.select(F.col("fp").alias("a"), F.col("first").alias("first_a"))
    second = distinct.select(F.col("fp").alias("b"), F.col("first").alias("first_b"))
    edges = forest.distinct().join(first, "a").join(second, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    roots = components(edges).withColumnRenamed("node", "first")
    named = distinct.join(roots, "first", "left").select("fp", F.coalesce("root", "first").alias("component"))
    return prints.join(named, "fp").select(plain_id(), "fp", F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"))


def hex_of(column: str):
    """16 lowercase hex digits of a long's 64 bits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
