"""Prefix trie of conversations: which openings they share, how many go on from each, and what sharing saves.

A node is a distinct sequence of first turns, known by the hash of that sequence. Turns are sorted by range, so that a long
conversation lies in several tasks; each task hashes its pieces and one row a task (its last conversation) carries the hash
on to the next. Subtree totals come from tree contraction (`contraction`).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, stored
from tidemark.llm.contraction import subtree_totals
from tidemark.llm.modular import BASES, PRIME, minus, plus, power, running, times

U = np.uint64
_HASHES = ["p0", "p1", "t0", "t1"]  # of the conversation up to a turn; of the turn


def _turn_hash(role: bytes, text: bytes) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(len(role).to_bytes(8, "little") + role + text)
    return (both & (1 << 64) - 1) % (PRIME - 1) + 1, (both >> 64) % (PRIME - 1) + 1  # never 0: each turn makes another node


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _pieces(batches):
    """Per sorted turn: part, conv_id, place within the part's piece of the conversation, hashes, words of the text."""
    part, last = TaskContext.get().partitionId(), None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = _longs(batch.column("conv_id"))
        roles, texts = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("role", "text"))
        turns = np.array([_turn_hash(r, t) for r, t in zip(roles, texts, strict=True)], U).T
        new = np.ones(n, bool)
        new[1:] = conv[1:] != conv[:-1]
        starts = np.flatnonzero(new)
        start = starts[np.cumsum(new) - 1]
        place, sums = np.arange(n) - start + 1, []
        for base, own in zip(BASES, turns, strict=True):
            s = running(times(own, power(base, np.arange(n))))
            sums.append(times(minus(s[1:], s[start]), power(base, -start)))
        if last is not None and last[0] == conv[0]:
            first = slice(0, starts[1] if len(starts) > 1 else n)
            for k, base in enumerate(BASES):
                sums[k][first] = plus(times(sums[k][first], pow(base, last[1], PRIME)), last[2 + k])
            place[first] += last[1]
        last = (conv[-1], int(place[-1]), sums[0][-1], sums[1][-1])
        words = np.array([len(t.split()) for t in texts], np.int64)
        columns = [np.full(n, part, np.int32), conv, place, *(x.view(np.int64) for x in (*sums, *turns)), words]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "conv_id", "pos", *_HASHES, "words"])


_PIECES = "part int, conv_id long, pos long, p0 long, p1 long, t0 long, t1 long, words long"


def _carried(pieces: DataFrame) -> DataFrame:
    """The pieces with place and hash counted from the begin of each conversation.

    The driver sees one row a partition: only a partition's first conversation can begin in an earlier one.
    """
    ends = pieces.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "pos", "p0", "p1")).alias("last"))
    before, open_ = {}, None
    for row in ends.orderBy("part").collect():
        last = tuple(row["last"])
        if open_ is not None and open_[0] == row["first"]:
            before[row["part"]] = open_
            if last[0] == open_[0]:
                last = (last[0], open_[1] + last[1], *((a + b * pow(base, open_[1], PRIME)) % PRIME for a, b, base in zip(open_[2:], last[2:], BASES, strict=True)))
        open_ = last

    def shifted(batches):
        for batch in batches:
            part, conv, pos = (_longs(batch.column(c)) for c in ("part", "conv_id", "pos"))
            sums = [_longs(batch.column(c)).view(U).copy() for c in ("p0", "p1")]
            pos = pos.copy()
            for p in np.unique(part):
                if int(p) in before:
                    known = before[int(p)]
                    own = (part == p) & (conv == known[0])
                    for k, base in enumerate(BASES):
                        sums[k][own] = plus(times(sums[k][own], pow(base, known[1], PRIME)), known[2 + k])
                    pos[own] += known[1]
            columns = [pa.array(pos), *(pa.array(s.view(np.int64)) for s in sums)]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("conv_id"), *columns, *(batch.column(c) for c in ("t0", "t1", "words"))], ["part", "conv_id", "pos", *_HASHES, "words"])

    return pieces.mapInArrow(shifted, _PIECES) if before else pieces


def _rebuilt(batches):
    """Nodes of a conversation's own turns, after those that it borrows took the place of its first `skip`."""
    for batch in batches:
        of = lambda c: _longs(batch.column(c))
        pos, skip, taken = of("pos"), of("skip"), of("taken")
        now, above = [], []
        for k, base in enumerate(BASES):
            moved = power(base, taken - skip)
            for out, at in ((now, pos), (above, pos - 1)):
                p = of(f"p{k}").view(U)
                if at is not pos:
                    p = minus(p, times(of(f"t{k}").view(U), power(base, at)))
                out.append(plus(times(minus(p, of(f"own{k}").view(U)), moved), of(f"base{k}").view(U)))
        columns = [taken + pos - skip, *(x.view(np.int64) for x in (*now, *above)), of("words"), pos == of("n")]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *map(pa.array, columns)], ["conv_id", *_MEMBER])


_MEMBER = ["depth", "a", "b", "up_a", "up_b", "words", "ends"]
_MEMBERS = "conv_id long, depth long, a long, b long, up_a long, up_b long, words long, ends boolean"


def members(conversations: DataFrame, base: Column | None = None, borrowed: Column | None = None, most: int = 3) -> DataFrame:
    """One row per conversation and node on its way: conv_id, depth, node (a, b), node above (up_a, up_b), words, ends.

    base and borrowed (at most `most`; columns over conv_id): the conversation's first `borrowed` turns are replaced by
    as many first turns of conversation `base` (all if it has fewer, none if it is absent).
    """
    parts = partitions(conversations.sparkSession)
    id_, text = F.col("conv_id").cast("long"), lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.where(id_.isNotNull()).select(id_.alias("conv_id"), "turn", text("role"), text("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    pieces = stored(turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(_pieces, _PIECES))
    rows = _carried(pieces)
    head = F.struct("pos", "p0", "p1", "words")
    convs = stored(rows.groupBy("conv_id").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(F.when(F.col("pos") <= most, head))).alias("heads")))
    zero = F.lit(0).cast("long")
    skip = F.lit(0) if borrowed is None else F.least(borrowed, F.lit(most))
    facts = convs.withColumns({"skip": skip.cast("long"), "base": F.col("conv_id") if base is None else base})
    facts = facts.join(convs.select(F.col("conv_id").alias("base"), F.col("heads").alias("lent")), "base", "left")
    facts = facts.withColumn("lent", F.slice(F.coalesce("lent", F.filter("heads", lambda x: F.lit(False))), 1, F.col("skip").cast("int")))
    facts = facts.withColumns({"taken": F.size("lent").cast("long"), "own": F.get("heads", F.least("skip", "n").cast("int") - 1), "last": F.get("lent", F.size("lent") - 1)})
    facts = stored(facts.select("conv_id", "n", "skip", "taken", "lent", *[F.coalesce(F.col(f"{c}.p{k}"), zero).alias(f"{name}{k}") for c, name in (("own", "own"), ("last", "base")) for k in (0, 1)]))

    # a conversation's facts go to each part that has some of it, so that its rows stay spread
    spread = rows.select("conv_id", "part").distinct().join(facts.drop("lent"), "conv_id")
    own = rows.join(spread, ["conv_id", "part"]).where("pos > skip").mapInArrow(_rebuilt, _MEMBERS)
    above = F.get("lent", F.col("i") - 1)
    lent = facts.select("conv_id", "n", "skip", "taken", "lent", F.posexplode("lent").alias("i", "x")).select(
        "conv_id", F.col("i").cast("long") + 1, "x.p0", "x.p1", F.coalesce(above["p0"], zero), F.coalesce(above["p1"], zero), "x.words", (F.col("n") <= F.col("skip")) & (F.col("i") + 1 == F.col("taken"))
    )
    none = F.lit(None).cast("long")
    roots = facts.select("conv_id", zero, zero, zero, none, none, zero, (F.col("taken") == 0) & (F.col("n") <= F.col("skip")))
    return own.union(lent).union(roots).toDF("conv_id", *_MEMBER)


def _joined_ids(batches):
    for batch in batches:
        a, b, conv = (_longs(batch.column(c)) for c in ("a", "b", "conv_id"))
        if not len(a):
            continue
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        starts = np.flatnonzero(new)
        texts = [",".join(map(str, x.tolist())) for x in np.split(conv, starts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(conv[starts]), pa.array(texts)], ["a", "b", "first", "ids"])


def _digests(batches):
    """One row per node: SHA-256 of its lists of ids, read one after the other."""
    key, digest = None, None
    for batch in batches:
        out = []
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
            if (a, b) != key:
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = (a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["a", "b", "ends_sha256"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], ["a", "b", "ends_sha256"])


def _ends_digest(found: DataFrame) -> DataFrame:
    """a, b, ends_sha256. Ids are joined where their range lies; only the joined pieces of a node come together, streamed."""
    parts = partitions(found.sparkSession)
    ends = found.where("ends").select("a", "b", "conv_id").repartitionByRange(parts, "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    lists = ends.mapInArrow(_joined_ids, "a long, b long, first long, ids string")
    return lists.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_digests, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, base: Column | None = None, borrowed: Column | None = None, most: int = 3) -> DataFrame:
    """One row per distinct sequence of first turns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text. Turns are ordered by turn (null first), then role, then text; repeated rows
    are turns of their own. A null role or text is empty, other columns are ignored. Rows without a conv_id belong to no
    conversation. An empty table has no conversation, so no node. For `base` and `borrowed` see `members`.
    """
    found = stored(members(conversations, base, borrowed, most))
    nodes = found.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.max(c).alias(c) for c in ("depth", "up_a", "up_b", "words")])
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()))
    children = nodes.where("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(nodes.join(above, ["up_a", "up_b"], "left"))
    own = nodes.select("id", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = subtree_totals(own, ["n_leaves", "saved_tokens"])
    out = nodes.join(totals, "id").join(_ends_digest(found), ["a", "b"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
