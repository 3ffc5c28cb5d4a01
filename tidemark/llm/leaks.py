"""Benchmark passages in documents, found in a latent semantic space and checked word by word.

1. Passages of 20 words give document frequencies of hashed words (a vector of fixed size, summed over all documents).
2. A randomised SVD of the TF-IDF matrix of all passages: each task adds up its part of A'AO for a random O; the driver
   gets one matrix of `features` x `rank` and takes its Nystroem decomposition.
3. Overlapping windows of documents and of benchmark items are folded into that space; a cosine of `cosine` or more makes
   a candidate. Items go round in blocks, so what a task holds is bounded.
4. A candidate is a leak if the longest common subsequence of the item and the text around the window has `share` of the
   item's words; with `paraphrase` of them, if most of the item's answer (its last words) is there as well.

Words are letters and digits, ASCII letters in lower case.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, expand, flat, keyed, plain_id, word_hashes, words_of

FEATURES, RANK, SIZE, STEP = 1 << 13, 64, 20, 10
ITEM_BLOCK = 2_000  # items that a task holds at once
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (one more at the end)."""
    data, ends = flat(column)
    data = LOWER[data]
    starts, stops, firsts = words_of(data, ends, NOT_WORD)
    return word_hashes(data, starts, stops), firsts


def _feature(words: np.ndarray) -> np.ndarray:
    return (words % np.uint64(FEATURES)).astype(np.int64)


def _cells(firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of consecutive cells of `size` words, the last of a text shorter; and where each text's cells begin."""
    counts = -(-np.diff(firsts) // size)
    before = np.concatenate([[0], np.cumsum(counts)])
    return expand(np.zeros(len(counts), np.int64), counts) * size + np.repeat(firsts[:-1], counts), before


def _summed(table: np.ndarray, feature: np.ndarray, firsts: np.ndarray, cells: np.ndarray, size: int) -> np.ndarray:
    """Sum of the table's rows over each cell; places beyond a text's end take the table's last row, which is zero."""
    counts = np.diff(firsts)
    index = np.full(len(cells) * size, len(table) - 1)
    starts = np.cumsum(np.append(0, -(-counts // size)))[:-1] * size
    index[expand(starts, counts)] = feature
    index = index.reshape(-1, size)
    out = table[index[:, 0]]
    for k in range(1, size):
        out += table[index[:, k]]
    return out


def _with_zero(table: np.ndarray) -> np.ndarray:
    return np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Number of passages with each feature, over all documents, and number of passages."""

    def rows(batches):
        total, passages = np.zeros(FEATURES, np.int64), 0
        for block in blocks(batches):
            words, firsts = plain_words(block.column("text"))
            cells, _ = _cells(firsts, SIZE)
            if len(cells):
                place = np.repeat(np.arange(len(cells)), np.diff(np.append(cells, len(words))))
                total += np.bincount(np.unique(place * FEATURES + _feature(words)) % FEATURES, minlength=FEATURES)
                passages += len(cells)
        yield pa.RecordBatch.from_arrays([pa.array([passages]), pa.array([total.tolist()], pa.list_(pa.int64()))], ["passages", "counts"])

    parts = docs.select("text").mapInArrow(rows, "passages long, counts array<long>")
    summed = parts.select("passages", F.posexplode("counts").alias("feature", "n")).groupBy("feature").agg(F.sum("n").alias("n"), F.sum("passages").alias("passages")).collect()
    out = np.zeros(FEATURES, np.int64)
    for r in summed:  # a row per feature
        out[r.feature] = r.n
    return out, int(summed[0].passages) if summed else 0


def _random(rank: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((FEATURES, rank), np.float32)


def latent_space(docs: DataFrame, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """Matrix that takes word features to coordinates (weights, directions and scales in one), fitted on all passages."""
    counts, passages = frequencies(docs)
    weight = np.log((1 + passages) / (1 + counts)).astype(np.float32)

    def rows(batches):
        directions = _with_zero(_random(rank, seed) * weight[:, None])
        total = np.zeros((FEATURES, rank), np.float32)
        for block in blocks(batches, 1 << 19):
            words, firsts = plain_words(block.column("text"))
            if not len(words):
                continue
            feature = _feature(words)
            cells, _ = _cells(firsts, SIZE)
            size = np.diff(np.append(cells, len(words)))
            norm = np.add.reduceat(weight[feature] ** 2, cells)
            mapped = _summed(directions, feature, firsts, cells, SIZE) / np.maximum(norm, 1e-6)[:, None]
            order = np.argsort(feature.astype(np.uint16), kind="stable")
            own = feature[order]
            begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            place = np.repeat(np.arange(len(cells)), size)[order]
            sums = [np.add.reduceat(column[place], begin) for column in np.ascontiguousarray(mapped.T)]  # each column lies together
            total[own[begin]] += np.stack(sums, axis=1)
        total *= weight[:, None]
        for k, part in enumerate(np.array_split(total, 16)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "data"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table["data"].to_pylist())
        return pa.table([table["part"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["part", "data"])

    parts = docs.select("text").mapInArrow(rows, "part int, data binary").groupBy("part").applyInArrow(add, "part int, data binary").collect()
    if not passages:
        return np.zeros((FEATURES, rank), np.float32)
    product = np.concatenate([np.frombuffer(r.data, np.float64) for r in sorted(parts, key=lambda r: r.part)]).reshape(FEATURES, rank)
    probe = _random(rank, seed).astype(np.float64)
    shift = 1e-6 * max(np.linalg.norm(product), 1e-12)
    product = product + shift * probe
    core = probe.T @ product
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    values = np.maximum(values, values.max() * 1e-9)
    left, scale, _ = np.linalg.svd(product @ (vectors / np.sqrt(values)), full_matrices=False)
    return (weight[:, None] * left / np.maximum(scale, scale.max() * 1e-4)).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def folded(words: np.ndarray, firsts: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of windows of SIZE words every STEP words, the text of each, and its first word."""
    cells, before = _cells(firsts, STEP)
    if not len(cells):
        return np.zeros((0, space.shape[1]), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = _summed(_with_zero(space), _feature(words), firsts, cells, STEP)
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    pair = np.append(text[1:] == text[:-1], False)
    sums[:-1] += sums[1:] * pair[:-1, None]  # a window is a cell and the next one
    alone = ~pair & ~np.append(False, pair[:-1])  # the last cell is in the window before it
    use = pair | alone
    return _unit(sums[use]), text[use], cells[use]


@dataclass
class Items:
    ids: list
    words: list[list[int]]
    masks: list[dict[int, int]]
    vectors: np.ndarray
    item: np.ndarray
    first: np.ndarray
    shown: np.ndarray


def prepared(rows: list, space: np.ndarray) -> Items:
    column = pa.array([r.text or "" for r in rows], pa.string())
    words, firsts = plain_words(column)
    vectors, item, first = folded(words, firsts, space)
    lists = [words[a:b].tolist() for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
    return Items([r.item_id for r in rows], lists, [masks(w) for w in lists], vectors, item, first - firsts[item], _window_words(words, firsts, item, first, 1))


def masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_subsequence(item: dict[int, int], n: int, text: list[int]) -> int:
    """Length of the longest common subsequence, all prefixes of the item at once as bits."""
    full = row = (1 << n) - 1
    for m in [m for m in map(item.get, text) if m]:
        u = row & m
        row = (row + u | row - u) & full
    return n - row.bit_count()


def leaks(documents: DataFrame, benchmark: DataFrame, cosine: float = 0.5, share: float = 0.8, paraphrase: float = 0.6, answer: int = 8, rank: int = RANK, item_block: int = ITEM_BLOCK) -> DataFrame:
    """doc_id, item_id, common (longest common subsequence over the item's words), cosine and start (word place) of each leak.

    One row per document and item, of its best place. Null and empty texts and items without a word match nothing;
    repeated rows fold into one (`keyed`); a null doc_id is an id of its own. Empty tables give an empty result.
    """
    docs = keyed(documents)
    space = latent_space(docs, rank)
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    n_blocks = -(-items.count() // item_block)
    schema = "doc_id long, item_id long, common double, cosine double, start long"
    out = None
    for k in range(max(1, n_blocks)):
        own = prepared(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n_blocks))) == k).collect(), space)

        def rows(batches, own=own):
            for block in blocks(batches):
                yield found(block, own, space, cosine, share, paraphrase, answer)

        part = docs.mapInArrow(rows, schema)
        out = part if out is None else out.unionByName(part)
    return out.select(plain_id(), "item_id", "common", "cosine", "start")


def _window_words(words: np.ndarray, firsts: np.ndarray, text: np.ndarray, first: np.ndarray, blank: int) -> np.ndarray:
    """32 bits of each word of each window; `blank` where a window is shorter."""
    places = first[:, None] + np.arange(SIZE)
    inside = places < firsts[text + 1][:, None]
    return np.where(inside, (words >> np.uint64(33)).astype(np.uint32)[np.minimum(places, max(0, len(words) - 1))] + np.uint32(2), np.uint32(blank)) if len(words) else np.zeros((0, SIZE), np.uint32)


def _sharing(windows: np.ndarray, items: np.ndarray, rows: np.ndarray, columns: np.ndarray, paraphrase: float):
    """Candidates whose windows really share words: at least the part of `paraphrase` that two shifted windows have in common."""
    keep = []
    sizes = (items != 1).sum(1)
    for at in range(0, len(rows), 1 << 15):
        a, b = windows[rows[at : at + (1 << 15)]], items[columns[at : at + (1 << 15)]]
        shared = np.zeros(len(a), np.int64)
        for k in range(SIZE):
            shared += (a == b[:, k : k + 1]).any(1)
        keep.append(shared >= (1 - STEP / 2 / SIZE) * paraphrase * sizes[columns[at : at + (1 << 15)]])
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return rows[keep], columns[keep]


def found(block: pa.RecordBatch, items: Items, space: np.ndarray, cosine: float, share: float, paraphrase: float, answer: int) -> pa.RecordBatch:
    words, firsts = plain_words(block.column("text"))
    vectors, text, first = folded(words, firsts, space)
    listed = words.tolist()
    shown = _window_words(words, firsts, text, first, 0)
    best: dict[tuple[int, int], tuple[float, float, int]] = {}
    tried: set[tuple[int, int, int]] = set()
    for begin in range(0, len(vectors) if len(items.vectors) else 0, 2048):
        near = vectors[begin : begin + 2048] @ items.vectors.T
        rows, columns = np.divmod(np.flatnonzero(near.ravel() >= cosine), near.shape[1])
        rows, columns = _sharing(shown[begin:], items.shown, rows, columns, paraphrase)
        for r, c in zip(rows.tolist(), columns.tolist(), strict=True):
            t, i = int(text[begin + r]), int(items.item[c])
            n = len(items.words[i])
            at = int(first[begin + r]) - int(items.first[c])
            if (t, i, at // STEP) in tried:
                continue
            tried.add((t, i, at // STEP))
            slack = STEP + n // 4
            low, high = max(int(firsts[t]), at - slack), min(int(firsts[t + 1]), at + n + slack)
            region = listed[low:high]
            if sum(map(items.masks[i].__contains__, region)) < paraphrase * n:
                continue
            common = common_subsequence(items.masks[i], n, region) / n
            if common < share:
                if common < paraphrase:
                    continue
                last = items.words[i][-answer:]
                if common_subsequence(masks(last), len(last), region) < 0.75 * len(last):
                    continue
            mark = (common, float(near[r, c]), -(low - int(firsts[t])))
            if mark > best.get((t, i), (0.0, 0.0, 0)):
                best[t, i] = mark
    ids = block.column("doc_id").to_numpy()
    keys = list(best)
    values = [best[k] for k in keys]
    return pa.RecordBatch.from_arrays(
        [pa.array([int(ids[t]) for t, _ in keys], pa.int64()), pa.array([items.ids[i] for _, i in keys], pa.int64()), *(pa.array([v[n] for v in values], pa.float64()) for n in (0, 1)), pa.array([-v[2] for v in values], pa.int64())],
        ["doc_id", "item_id", "common", "cosine", "start"],
    )
