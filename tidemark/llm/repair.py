"""Token ids in shards, compressed by a Re-Pair grammar, with access to any document.

A shard holds the documents of a range of ids. Its ids are one sequence in which frequent pairs of neighbours are
replaced by nonterminals, round after round. A round first halves runs of one symbol, then splits the symbols into left and
right ones at random and replaces all frequent pairs of a left and a right symbol at once, which cannot overlap. It stops
after `ROUNDS` rounds or `MAX_RULES` rules: more of them would save little for their time. A shard stores the sequence, the rules, the expansion length of each rule, and for each document its first symbol.
No replacement crosses a document's end, since the end id never enters a rule; so a document is decoded by itself.
"""

from __future__ import annotations

import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, expand, keyed, mixed, partitions, plain_id
from tidemark.llm.vocab import LIMIT, byte_bpe
from tidemark.session import scratch_folder

END = 2
SHARD_BYTES = 4 << 20
MIN_COUNT, MAX_RULES, ROUNDS = 16, 1 << 15, 10
SHARD = "part int, shard int, n_tokens long, doc_ids binary, firsts binary, sizes binary, sequence binary, rules binary, lengths binary, base int"


def _halved_runs(sequence: np.ndarray, rules: np.ndarray, base: int, end: int, min_count: int):
    """Pairs of one symbol twice: in each run of equal symbols every second one goes, until no such pair is frequent.

    A step makes no equal neighbours but among its own nonterminals, so only these are looked at again.
    """
    first = np.flatnonzero(sequence[1:] == sequence[:-1])
    first = first[sequence[first] != end]
    second, gone = first + 1, []
    while len(first) >= min_count:
        # of a chain of pairs, each beginning with the symbol that ends the one before, every second one
        at = np.arange(len(first))
        begins = np.r_[True, first[1:] != second[:-1]]
        hit = (at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0
        first, second = first[hit], second[hit]
        own = sequence[first]
        counts = np.bincount(own)
        symbols = np.flatnonzero(counts >= min_count)
        if not len(symbols):
            break
        often = counts[own] >= min_count
        first, second, own = first[often], second[often], own[often]
        if not gone:
            sequence = sequence.copy()
        sequence[first] = base + len(rules) + np.searchsorted(symbols, own)
        gone.append(second)
        rules = np.concatenate([rules, np.stack([symbols] * 2, 1)])
        width = 1 << len(gone)
        twin = np.flatnonzero((first[1:] == first[:-1] + width) & (own[1:] == own[:-1]))
        first, second = first[twin], first[twin + 1]
    return (_without(sequence, np.concatenate(gone)) if gone else sequence), rules


def _without(sequence: np.ndarray, gone: np.ndarray) -> np.ndarray:
    keep = np.ones(len(sequence), bool)
    keep[gone] = False
    return sequence[keep]


SLOTS = 17  # bits
LEFT, END_SIDE, RIGHT = 1, 2, 3


def compress(ids: np.ndarray, end: int = END, min_count: int = MIN_COUNT, max_rules: int = MAX_RULES, rounds: int = ROUNDS):
    """Sequence, rules (left, right), expansion lengths and the first nonterminal. The limits bound time, not what is stored."""
    base = int(ids.max(initial=0)) + 1
    sequence, rules = ids.astype(np.int32), np.zeros((0, 2), np.int64)
    for turn in range(rounds):
        sequence, rules = _halved_runs(sequence, rules, base, end, min_count)
        if len(sequence) < 2 or len(rules) >= max_rules:
            break
        # symbols that may stand left, others right: pairs of one round cannot overlap
        side = np.where(mixed(np.arange(base + len(rules), dtype=np.uint64) + np.uint64(turn << 32)) & np.uint64(1), LEFT, RIGHT).astype(np.int8)
        if end < len(side):
            side[end] = END_SIDE
        side = np.take(side, sequence, mode="clip")
        at = np.flatnonzero(side[1:] - side[:-1] == RIGHT - LEFT)
        first, second = sequence[at], sequence[at + 1]
        slot = _slots(first, second)
        full = np.flatnonzero((np.bincount(slot, minlength=1 << SLOTS) >= min_count)[slot])  # a pair is no more frequent than its slot
        at, slot = at[full], slot[full]
        key = (first[full].astype(np.int64) << 32) | second[full]
        pairs, counts = np.unique(key, return_counts=True)
        often = counts >= min_count
        pairs, counts = pairs[often], counts[often]
        pairs = np.sort(pairs[np.argsort(-counts, kind="stable")[: max_rules - len(rules)]])
        if not len(pairs):
            continue
        # a slot with one such pair tells it; in others pairs are searched
        own = _slots((pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32))
        shared = np.bincount(own, minlength=1 << SLOTS) > 1
        by_slot = np.zeros(1 << SLOTS, np.int32)
        by_slot[own] = np.arange(len(pairs))
        place = by_slot[slot]
        unclear = np.flatnonzero(shared[slot])
        place[unclear] = np.minimum(np.searchsorted(pairs, key[unclear]), len(pairs) - 1)
        found = np.flatnonzero(pairs[place] == key)
        hit = at[found]
        sequence[hit] = base + len(rules) + place[found]
        sequence = _without(sequence, hit + 1)
        rules = np.concatenate([rules, np.stack([pairs >> 32, pairs & 0xFFFFFFFF], 1)])
    sizes = [1] * base
    for left, right in rules.tolist():
        sizes.append(sizes[left] + sizes[right])
    return sequence, rules, np.array(sizes[base:], np.int64), base


def _slots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixture = first.view(np.uint32) * np.uint32(0x9E3779B1) + second.view(np.uint32) * np.uint32(0x85EBCA77)
    return (mixture ^ mixture >> np.uint32(15)) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - SLOTS)


def expanded(sequence: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """Ids of a sequence of symbols. In a long one each symbol's ids are found once, then gathered."""
    if len(sequence) < base + len(rules):
        return _refined(sequence, rules, lengths, base)
    plain, made = np.arange(base), _refined(base + np.arange(len(rules)), rules, lengths, base)
    sizes = np.concatenate([np.ones(base, np.int64), lengths])
    starts = np.cumsum(sizes) - sizes
    return np.concatenate([plain, made]).astype(np.int32)[expand(starts[sequence], sizes[sequence])]


def _refined(sequence: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """Lengths give each symbol's place, so rounds only refine what is not an id yet."""
    size = np.where(sequence >= base, lengths[np.maximum(sequence - base, 0)] if len(lengths) else 1, 1)
    out = np.zeros(int(size.sum()), np.int32)
    at, symbols = np.cumsum(size) - size, sequence
    while True:
        plain = symbols < base
        out[at[plain]] = symbols[plain]
        symbols, at = symbols[~plain], at[~plain]
        if not len(symbols):
            return out
        left, right = rules[symbols - base].T
        step = np.where(left >= base, lengths[np.maximum(left - base, 0)], 1)
        symbols, at = np.concatenate([left, right]), np.concatenate([at, at + step])


def shards(documents: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, end: int = END) -> DataFrame:
    """One row per shard (columns of SHARD), documents in the order of doc_id, each with the end id."""

    def rows(batches):
        table, part = byte_bpe(path), TaskContext.get().partitionId()
        shard = count()
        for batch in batches:
            ids, counts, docs, have = [], [], [], 0
            for block in blocks([batch], shard_bytes):
                some, n = table.encode(block.column("text"))
                out = np.full(len(some) + len(n), end, np.int32)
                out[np.arange(len(some)) + np.repeat(np.arange(len(n)), n)] = some
                ids.append(out)
                counts.append(n + 1)
                docs.append(block.column("doc_id").to_numpy())
                have += block.column("text").nbytes
                if have >= shard_bytes:
                    yield _shard(part, next(shard), ids, counts, docs, end)
                    ids, counts, docs, have = [], [], [], 0
            if docs:
                yield _shard(part, next(shard), ids, counts, docs, end)
        if table.n > LIMIT:
            table.trim()  # the worker may go on to other tasks

    docs = keyed(documents)
    ordered = docs.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(rows, SHARD)


def _shard(part, shard, ids, counts, docs, end) -> pa.RecordBatch:
    ids, counts, docs = map(np.concatenate, (ids, counts, docs))
    sequence, rules, lengths, base = compress(ids, end)
    stops = np.flatnonzero(sequence == end) + 1 if (ids == end).sum() == len(docs) else None
    if stops is None:  # a text may hold the end id itself: count its places by expansion
        size = np.where(sequence >= base, lengths[np.maximum(sequence - base, 0)] if len(lengths) else 1, 1)
        stops = np.searchsorted(np.cumsum(size), np.cumsum(counts)) + 1
    firsts = np.append(0, stops[:-1])
    values = (docs.astype("<i8"), firsts.astype("<u4"), counts.astype("<u4"), sequence.astype("<u4"), rules.astype("<u4"), lengths.astype("<u4"))
    columns = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([int(counts.sum())]), *(pa.array([v.tobytes()], pa.binary()) for v in values), pa.array([base], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SHARD.split(", ")])


def write_shards(documents: DataFrame, path: str, folder: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes the shards of all documents to `folder`, a row of a Parquet file each."""
    shards(documents, path, shard_bytes).write.mode("overwrite").option("compression", "zstd").parquet(folder)


PLACES = ["part", "shard", "doc_id", "offset", "n_tokens"]


def _documents(batches):
    """Of each batch of shard rows: columns of PLACES, and the ids of each document as bytes, in pieces of about 4 MB."""
    for batch in batches:
        for r in batch.to_pylist():
            docs, sizes, sequence, rules, lengths = (np.frombuffer(r[c], t).astype(np.int64) for c, t in (("doc_ids", "<i8"), ("sizes", "<u4"), ("sequence", "<u4"), ("rules", "<u4"), ("lengths", "<u4")))
            ids = expanded(sequence, rules.reshape(-1, 2), lengths, r["base"])
            offsets = np.cumsum(sizes) - sizes
            data = memoryview(ids.astype("<u4", copy=False)).cast("B")
            for some in np.array_split(np.arange(len(docs)), max(1, len(data) >> 22)):
                values = [data[4 * o : 4 * (o + n)] for o, n in zip(offsets[some].tolist(), sizes[some].tolist(), strict=True)]
                yield [pa.array(np.full(len(some), r["part"]), pa.int32()), pa.array(np.full(len(some), r["shard"]), pa.int32()), pa.array(docs[some]), pa.array(offsets[some]), pa.array(sizes[some])], values


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Documents from written shards: part and shard (places of the shard), doc_id, offset (ids before it in the shard) and ids."""

    def rows(batches):
        for places, ids in _documents(batches):
            yield pa.RecordBatch.from_arrays([*places, pa.array(map(bytes, ids), pa.binary())], [*PLACES, "ids"])

    return spark.read.parquet(folder).mapInArrow(rows, "part int, shard int, doc_id long, offset long, n_tokens long, ids binary")


def document_ids(shard: dict, doc_id: int) -> np.ndarray | None:
    """Ids of one document of a shard row, decoded by itself."""
    docs = np.frombuffer(shard["doc_ids"], "<i8")
    at = int(np.searchsorted(docs, doc_id))
    if at == len(docs) or docs[at] != doc_id:
        return None
    firsts, sequence = np.frombuffer(shard["firsts"], "<u4"), np.frombuffer(shard["sequence"], "<u4").astype(np.int64)
    stop = firsts[at + 1] if at + 1 < len(docs) else len(sequence)
    rules, lengths = np.frombuffer(shard["rules"], "<u4").astype(np.int64).reshape(-1, 2), np.frombuffer(shard["lengths"], "<u4").astype(np.int64)
    return expanded(sequence[firsts[at] : stop], rules, lengths, shard["base"])


def token_output(documents: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Writes all documents as shards and returns, read back from them: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before. Null and empty texts are the end id alone; repeated rows fold into one
    (`keyed`); a null doc_id comes first; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    folder = folder or scratch_folder(spark)
    write_shards(documents, path, folder)

    def digests(batches):  # in the task that reads the ids, which are not sent on
        for places, ids in _documents(batches):
            yield pa.RecordBatch.from_arrays([*places, pa.array(map(zlib.crc32, ids), pa.int64())], [*PLACES, "ids_crc32"])

    docs = spark.read.parquet(folder).mapInArrow(digests, "part int, shard int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    placed = docs.join(shard_starts(spark, folder), ["part", "shard"])
    return placed.select(plain_id(), (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """part, shard and before, the ids of all shards before it: sums per part, then within each part."""
    sizes = spark.read.parquet(folder).select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))  # a row per part
    own = Window.partitionBy("part").orderBy("shard")
    return sizes.join(ahead, "part").select("part", "shard", (F.col("ahead") + F.sum("n_tokens").over(own) - F.col("n_tokens")).alias("before"))
