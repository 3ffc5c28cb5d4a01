"""Which parts of a corpus can hold repeats at all: minimizers that occur twice.

Each window of `width` symbols has a minimizer, the smallest hash among its k-symbol strings. Equal windows have equal
minimizers, so a window whose minimizer occurs once repeats nowhere. Runs of windows with one minimizer are one entry;
only entries are shuffled (one per 6 words or 14 bytes), packed per task and bucket. A bucket answers with flags in the
order in which the entries came, so that no positions travel. Answers are packed per task and group of documents, too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.common import _BYTES, binary, blocks, expand, flat, inner, joined, mixed, sliding_min, window_hashes, word_hashes, words_of


_UPPER, _LOWER = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


@dataclass
class Runs:
    """Runs of consecutive windows of one text that have their minimizer at one place, in order of text and place.

    Equal windows have it at equal offsets, so no two windows of one run are equal.
    """

    anchors: np.ndarray
    lengths: np.ndarray
    docs: np.ndarray  # row of the text within the block
    places: np.ndarray  # of each window among all symbols of the block
    symbols: np.ndarray  # hashes of words, or bytes
    firsts: np.ndarray  # where each text's symbols begin
    others: np.ndarray  # a second hash of words, independent of the first


def runs_of(column: pa.Array, words: bool, width: int, k: int, twice: bool = False) -> Runs:
    data, ends = flat(column)
    others = np.zeros(0, np.uint64)
    if words:
        starts, stops, firsts = words_of(data, ends)
        symbols = values = word_hashes(data, starts, stops)
        others = word_hashes(data, starts, stops, 1) if twice else others
    else:
        symbols, values, firsts = data, _BYTES[data], ends
    hashes = window_hashes(values, k)
    # the upper half decides, then the leftmost place: a rule that sees nothing but the window
    smallest = sliding_min((hashes & _UPPER) | np.arange(len(hashes), dtype=np.uint64), width - k + 1)
    places, counts = inner(firsts, width)
    chosen, docs = (smallest[places] & _LOWER).astype(np.int64), np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(chosen), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(new)
    return Runs(hashes[chosen[at]], np.diff(np.append(at, len(chosen))), docs[at], places, symbols, firsts, others)


def packed(ids: np.ndarray, owner: np.ndarray, bucket: np.ndarray, columns: list[np.ndarray], parts: int):
    """One row per bucket: ids of its texts, entries of each, and the columns' values in the same order."""
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(parts + 1))
    rows = []
    for b in range(parts):
        own = order[cuts[b] : cuts[b + 1]]
        if len(own):
            texts, counts = np.unique(owner[own], return_counts=True)
            rows.append((b, ids[texts], counts.astype(np.uint32), *(c[own] for c in columns)))
    return [pa.array([r[0] for r in rows], pa.int32()), *(binary([r[i] for r in rows]) for i in range(1, 3 + len(columns)))]


def possible_repeats(docs: DataFrame, words: bool, width: int, k: int, parts: int, across: bool) -> DataFrame:
    """Per text with a repeated minimizer: doc_id, and buckets and flags of its entries. across: occurrences in one text only don't count."""

    def entries(batches):
        for batch in batches:
            ids, owners, anchors, base = [], [], [], 0
            for block in blocks([batch]):
                runs = runs_of(block.column("text"), words, width, k)
                ids.append(block.column("doc_id").to_numpy())
                owners.append(runs.docs + base)
                anchors.append(runs.anchors)
                base += block.num_rows
            if base:
                h = np.concatenate(anchors)
                columns = packed(np.concatenate(ids), np.concatenate(owners), (h % np.uint64(parts)).astype(np.int64), [(h >> np.uint64(32)).astype(np.uint32)], parts)
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "ids", "counts", "hashes"])

    def answers(table: pa.Table) -> pa.Table:
        ids, counts, h = joined(table["ids"], np.int64), joined(table["counts"], np.uint32).astype(np.int64), joined(table["hashes"], np.uint32)
        # 32 bits within a bucket: two minimizers taken for one only add windows that are then found to be single
        order = np.argsort(h, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        group = np.cumsum(new) - 1
        if across:
            owner = np.repeat(ids, counts)[order]
            at = np.flatnonzero(new)
            repeated = np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at)
        else:
            repeated = np.bincount(group) > 1
        flags = np.zeros(len(h), np.uint8)
        flags[order] = repeated[group]
        begin = np.cumsum(counts) - counts
        some = np.flatnonzero(np.maximum.reduceat(flags, begin))
        entries_ = expand(begin[some], counts[some])
        bucket = np.full(len(entries_), table["bucket"][0].as_py(), np.int32)
        return addressed(np.repeat(ids[some], counts[some]), [bucket, flags[entries_]], ["buckets", "flags"], parts)

    sent = docs.mapInArrow(entries, "bucket int, ids binary, counts binary, hashes binary")
    back = sent.groupBy("bucket").applyInArrow(answers, address_schema(["buckets", "flags"]))
    return delivered(back, {"buckets": np.int32, "flags": np.uint8})


def address_schema(names: list[str]) -> str:
    return "target int, ids binary, counts binary, " + ", ".join(f"{n} binary" for n in names)


def addressed(docs: np.ndarray, columns: list[np.ndarray], names: list[str], parts: int) -> pa.Table:
    """Values for documents, in rows by group of documents (target); the order of a document's values is kept."""
    ids, owner = np.unique(docs, return_inverse=True)
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    target = (mixed(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    rows = packed(ids, owner, target[owner] if len(ids) else owner, [c[order] for c in columns], parts)
    return pa.table(rows, ["target", "ids", "counts", *names])


def delivered(rows: DataFrame, kinds: dict) -> DataFrame:
    """One row per document: doc_id and each column's values as bytes."""
    names = list(kinds)

    def merge(table: pa.Table) -> pa.Table:
        docs = np.repeat(joined(table["ids"], np.int64), joined(table["counts"], np.uint32))
        order = np.argsort(docs, kind="stable")
        ids, counts = np.unique(docs, return_counts=True)
        out = [pa.array(ids)]
        for n in names:
            values = joined(table[n], kinds[n])[order]
            ends = (np.append(0, np.cumsum(counts)) * values.itemsize).astype(np.int64)
            lists = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])
            out.append(lists.cast(pa.binary()))
        return pa.table(out, ["doc_id", *names])

    return rows.groupBy("target").applyInArrow(merge, "doc_id long, " + ", ".join(f"{n} binary" for n in names))


def flagged(runs: Runs, batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """The answers (columns buckets and flags) for the runs of a block, in their order."""
    key = runs.docs * parts + (runs.anchors % np.uint64(parts)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    buckets = batch.column("buckets")
    owner = np.repeat(np.arange(len(buckets)), pc.binary_length(buckets).to_numpy() // 4)
    told = owner * parts + joined(pa.chunked_array([buckets]), np.int32)
    flags = joined(pa.chunked_array([batch.column("flags")]), np.uint8)
    out = np.zeros(len(key), bool)
    out[order[np.isin(key[order], told)]] = flags[np.argsort(told, kind="stable")]
    return out
