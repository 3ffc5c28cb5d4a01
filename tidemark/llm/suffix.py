"""Byte strings shared between documents, by interval expansion on a Burrows-Wheeler transform.

Windows that can repeat are found by minimizers (`anchors`); their runs go to the bucket of their minimizer, where equal
windows always meet. Equal runs fold into one text there. Over the texts of a bucket, in pieces of bounded size, a
Burrows-Wheeler transform is built. Starting with the interval of all suffixes, a breadth-first search extends intervals
backwards by one byte at a time: the end of each interval reached first at depth l has a longest common prefix of l with
the suffix before it. The search stops at `width`; ends not reached by then lie within a class of equal windows.
A window is removed where the smallest doc_id of its class is smaller than its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.anchors import address_schema, addressed, delivered, flagged, possible_repeats, runs_of
from tidemark.llm.common import U, blocks, expand, joined, keyed, partitions, plain_id

PIECE = 1 << 19  # symbols of one transform


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of a sequence (values 0..256) sorted by their first `depth` symbols at least."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = (key << 9) | np.roll(symbols, -k)
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 7
    while step < depth:
        at = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(at):
            break
        own = order[at]
        second = rank[(own + step) % n]
        pair = rank[own] * n + second
        sort = np.argsort(pair, kind="stable")
        own, pair = own[sort], pair[sort]
        order[at] = own
        split = np.ones(len(at), bool)
        split[1:] = pair[1:] != pair[:-1]
        new[at] = split
        rank = rank.copy()
        rank[own] = np.maximum.accumulate(np.where(split, at, 0))
        step *= 2
    return order


def prefix_classes(symbols: np.ndarray, width: int) -> np.ndarray:
    """Class of each place of a cyclic sequence: places are equal in their first `width` symbols or in different classes."""
    n = len(symbols)
    order = suffix_order(symbols, width)
    transform = symbols[order - 1]
    step = np.empty(n, np.int64)  # of a place of the transform: the suffix longer by that symbol
    step[np.argsort(transform, kind="stable")] = np.arange(n)
    common = np.full(n + 1, -1, np.int64)
    common[[0, n]] = 0
    low, high = np.array([0]), np.array([n])
    for length in range(width):
        sizes = high - low
        places = expand(low, sizes)
        key = np.repeat(np.arange(len(low)), sizes) * 257 + transform[places]
        sort = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[sort][1:] != key[sort][:-1]])
        count = np.diff(np.append(first, len(key)))
        low = step[places[sort[first]]]
        high = low + count
        fresh = common[high] == -1
        common[high[fresh]] = length
        if not length:
            fresh[:] = True  # the last symbol ends at n
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(common[:-1] >= 0)
    return out


def window_owners(texts: list[bytes], owners: np.ndarray, width: int) -> np.ndarray:
    """For each window of each text, in order: the smallest owner of a text that has it."""
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int64) + 1
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)
    data[ends - 1] = 0
    classes = prefix_classes(data, width)
    counts = lengths - width + 1
    places = expand(ends - 1 - lengths, counts)
    own, inverse = np.unique(classes[places], return_inverse=True)
    least = np.full(len(own), np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, np.repeat(owners, counts))
    return least[inverse]


def shared_windows(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, starts and counts_ (32-bit integers as bytes) of runs of windows of keyed documents that a smaller doc_id has too."""
    parts, k = partitions(docs.sparkSession), max(1, width // 2 - 1)
    marks = possible_repeats(docs, False, width, k, parts, across=True)

    def segments(batches):
        for batch in batches:
            kept, base = [], 0
            for block in blocks([batch]):
                runs = runs_of(block.column("text"), False, width, k)
                keep = np.flatnonzero(flagged(runs, block, parts))
                begin = runs.places[(np.cumsum(runs.lengths) - runs.lengths)[keep]] if len(keep) else np.zeros(0, np.int64)
                size = runs.lengths[keep]
                data = runs.symbols[expand(begin, size + width - 1)]
                kept.append((runs.docs[keep] + base, runs.anchors[keep], begin - runs.firsts[runs.docs[keep]], size, data))
                base += block.num_rows
            if not base:
                continue
            doc, anchor, start, size, data = (np.concatenate(x) for x in zip(*kept, strict=True))
            ids = batch.column("doc_id").to_numpy()
            bucket = (anchor % U(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            from_ = (np.cumsum(size + width - 1) - (size + width - 1))[order]
            doc, anchor, start, size = doc[order], anchor[order], start[order], size[order]
            cuts = np.searchsorted(bucket[order], np.arange(parts + 1))
            rows = []
            for b in range(parts):
                own = slice(cuts[b], cuts[b + 1])
                if cuts[b] < cuts[b + 1]:
                    rows.append((b, ids[doc[own]], (anchor[own] >> U(32)).astype(np.uint32), start[own].astype(np.uint32), size[own].astype(np.uint16), data[expand(from_[own], size[own] + width - 1)]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in range(1, 6))], ["bucket", "ids", "anchors", "starts", "sizes", "data"])

    def classes(table: pa.Table) -> pa.Table:
        ids, anchors = joined(table["ids"], np.int64), joined(table["anchors"], np.uint32)
        starts, sizes = joined(table["starts"], np.uint32), joined(table["sizes"], np.uint16).astype(np.int64)
        data = b"".join(table["data"].to_pylist())
        ends = np.cumsum(sizes + width - 1).tolist()
        number: dict[bytes, int] = {}
        which = np.fromiter((number.setdefault(data[a:b], len(number)) for a, b in zip([0, *ends[:-1]], ends, strict=True)), np.int64, len(ends))
        del data
        texts = list(number)
        owner = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(owner, which, ids)
        anchor = np.zeros(len(texts), np.uint32)
        anchor[which] = anchors
        count = np.fromiter(map(len, texts), np.int64, len(texts)) - width + 1
        begin = np.cumsum(count) - count
        least = np.repeat(owner, count)
        # texts of one minimizer stay together; a text alone with its minimizer shares its windows with no other text
        order = np.argsort(anchor, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = anchor[order][1:] != anchor[order][:-1]
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        order, group = order[several], group[several]
        size = np.cumsum(count[order] + width)
        at = 0
        while at < len(order):
            stop = int(np.searchsorted(size, (size[at - 1] if at else 0) + PIECE, "right"))
            stop = max(stop, at + 1)
            while stop < len(order) and group[stop] == group[stop - 1]:
                stop += 1
            own = order[at:stop]
            least[expand(begin[own], count[own])] = window_owners([texts[i] for i in own.tolist()], owner[own], width)
            at = stop
        out = [[], [], []]
        for some in np.array_split(np.arange(len(which)), max(1, len(which) >> 17)):  # occurrences in bounded lots
            own = which[some]
            n = count[own]
            removed = least[expand(begin[own], n)] < np.repeat(ids[some], n)
            edge = np.zeros(len(removed), bool)
            edge[np.cumsum(n) - n] = True
            first = np.flatnonzero(removed & (edge | ~np.append(False, removed[:-1])))
            last = np.flatnonzero(removed & np.append(edge[1:] | ~removed[1:], True))
            lot = np.repeat(np.arange(len(some)), n)[first]
            for to, x in zip(out, (ids[some][lot], starts[some][lot] + (first - (np.cumsum(n) - n)[lot]), last - first + 1), strict=True):
                to.append(x)
        doc, start, length = (np.concatenate(x) for x in out)
        return addressed(doc, [start.astype(np.uint32), length.astype(np.uint32)], ["starts", "counts_"], parts)

    sent = docs.join(marks, "doc_id").select("doc_id", "text", "buckets", "flags").mapInArrow(segments, "bucket int, ids binary, anchors binary, starts binary, sizes binary, data binary")
    back = sent.groupBy("bucket").applyInArrow(classes, address_schema(["starts", "counts_"]))
    return delivered(back, {"starts": np.uint32, "counts_": np.uint32})


def remove_shared(documents: DataFrame, width: int = 50) -> DataFrame:
    """Documents without bytes covered by a `width`-byte string that a document with a smaller doc_id has as well.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary, the remaining bytes). Null texts
    are empty; repeated rows fold into one (`keyed`); shorter texts keep everything; an empty table gives an empty result.
    """
    docs = keyed(documents)
    whole = docs.join(shared_windows(docs, width), "doc_id", "left").select("doc_id", "text", "starts", "counts_")

    def without(batches):
        for batch in batches:
            rows = []
            for text, starts, counts in zip(batch.column("text").cast(pa.binary()), batch.column("starts"), batch.column("counts_"), strict=True):
                text = text.as_py()
                if not starts.is_valid:
                    rows.append((len(text), 0, 0, text))
                    continue
                start, count = (np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in (starts, counts))
                change = np.zeros(len(text) + 1, np.int64)
                np.add.at(change, start, 1)
                np.subtract.at(change, start + count + width - 1, 1)
                gone = np.cumsum(change[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((len(text), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), kept))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = whole.mapInArrow(without, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(plain_id(), "n_bytes", "n_removed", "n_spans", "kept")
