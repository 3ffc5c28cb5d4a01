"""Groups of spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

A word's vector counts its letters. One inserted or deleted letter moves it by 1, one replaced letter by 2 (L1 distance). So
words of one length are searched within 2 and words of neighbouring lengths within 1: per pair of lengths a tree is walked by
all queries at once, and a node is left by those that are too far from its box. What is left is compared letter by letter.

The upper levels of each length's tree are the same for the whole cluster. Their planes come from a bounded sample of words,
which decides where words lie, never whether they are found; each of its cells is a task's tree. A word visits all cells whose
box is within reach.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, blocks, expand, keyed, stored

SAMPLE = 20_000  # words from which the planes of the upper trees are taken
CELL = 4_000  # words that a cell of the upper trees shall hold
LEAF = 16
AT_ONCE = 1 << 16  # (query, node) pairs or candidates that are worked on together
DIMENSIONS = 32  # a to z, and the other letters folded into six: folding only brings vectors nearer

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def variants(docs: DataFrame, every: int, shortest: int) -> DataFrame:
    """word and n of keyed documents, counted per task: runs of letters, A-Z lower-cased, some with a letter deleted.

    With h the crc32 of "<doc_id>:<run>", a run for which `every` divides h loses its letter h % length (0: none does).
    """

    def counted(batches):
        total = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for block in blocks([batch]):
                for doc, text in zip(block.column("doc_id").to_pylist(), block.column("text").cast(pa.binary()), strict=True):
                    start = zlib.crc32(f"{'' if doc == NO_ID else doc}:".encode())
                    for run, n in Counter(RUN.findall(text.as_py().lower().decode())).items():
                        if every:
                            h = zlib.crc32(run.encode(), start)
                            if h % every == 0:
                                at = h % len(run)
                                run = run[:at] + run[at + 1 :]
                        if len(run) >= shortest:
                            total[run] += n
                if len(total) > 200_000:
                    yield rows()
        if total:
            yield rows()

    return docs.mapInArrow(counted, "word string, n long")


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _vectors(letters: np.ndarray) -> np.ndarray:
    plain = (letters >= 97) & (letters <= 122)
    dim = np.where(plain, letters - 97, 26 + letters % (DIMENSIONS - 26)).astype(np.int64)
    out = np.zeros((len(letters), DIMENSIONS), np.int16 if letters.shape[1] < 1 << 15 else np.int32)
    np.add.at(out, (np.arange(len(letters))[:, None], dim), 1)
    return out


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts of words of any lengths."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    out = np.zeros((len(words), DIMENSIONS), np.int32)
    for at in by_length.values():
        out[at] = _vectors(_letters([words[i] for i in at]))
    return out


class Tree:
    """K-d tree over count vectors: nodes as arrays, rows of a node contiguous in `order`, the tight box of each node."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        self.first, self.last, self.left, self.planes, self.low, self.high = [0], [len(points)], [], [], [], []
        node = 0
        while node < len(self.first):
            a, b = self.first[node], self.last[node]
            own = points[self.order[a:b]]
            low, high = own.min(0), own.max(0)
            self.low.append(low)
            self.high.append(high)
            plane = _plane(own, low, high) if b - a > leaf else None
            self.planes.append(plane)
            self.left.append(len(self.first) if plane else 0)
            if plane:
                side = own[:, plane[0]] >= plane[1]
                self.order[a:b] = np.concatenate([self.order[a:b][~side], self.order[a:b][side]])
                mid = b - int(side.sum())
                self.first += [a, mid]
                self.last += [mid, b]
            node += 1
        self.first, self.last, self.left, self.low, self.high = map(np.array, (self.first, self.last, self.left, self.low, self.high))

    def near(self, queries: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, point) at a distance of `reach` at most, and others in the leaves that such queries come to."""
        stack = [(np.arange(len(queries)), np.zeros(len(queries), np.int64))] if len(self.order) else []
        while stack:
            q, node = stack.pop()
            if len(q) > AT_ONCE:
                stack += list(zip(np.array_split(q, 2), np.array_split(node, 2), strict=True))
                continue
            v = queries[q]
            far = (np.maximum(self.low[node] - v, 0) + np.maximum(v - self.high[node], 0)).sum(1) > reach
            q, node = q[~far], node[~far]
            ends = self.left[node] == 0
            if ends.any():
                sizes = (self.last - self.first)[node[ends]]
                yield np.repeat(q[ends], sizes), self.order[expand(self.first[node[ends]], sizes)]
            q, below = q[~ends], self.left[node[~ends]]
            if len(q):
                stack.append((np.concatenate([q, q]), np.concatenate([below, below + 1])))


def _plane(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[int, int] | None:
    """Letter and count that halve the points best; None if all are equal."""
    best, plane = len(points), None
    for d in np.flatnonzero(low < high).tolist():
        counts = np.bincount(points[:, d] - low[d])
        above = len(points) - np.cumsum(counts)[:-1]
        cut = int(np.abs(2 * above - len(points)).argmin())
        uneven = abs(2 * int(above[cut]) - len(points))
        if uneven < best:
            best, plane = uneven, (d, int(low[d]) + cut + 1)
    return plane


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of code points, b as long as a or one longer: whether exactly one letter is replaced, or inserted."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(1) == 1
    front = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return front + back >= n


def near_pairs(short: list[str], long: list[str], reach: int, tree: Tree | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of words one edit apart; all of `long` have the length of `short` or one more."""
    if not short or not long:
        return
    a, b = _letters(short), _letters(long)
    points, queries = _vectors(a), _vectors(b)
    for j, i in (tree or Tree(points, LEAF)).near(queries, reach):
        step = max(1, 32 * AT_ONCE // b.shape[1])
        for part in range(0, len(i), step):
            p, q = i[part : part + step], j[part : part + step]
            close = np.abs(points[p] - queries[q]).sum(1) <= reach
            p, q = p[close], q[close]
            good = one_edit(a[p], b[q])
            if good.any():
                yield p[good], q[good]


class Upper:
    """Upper levels of the trees of all lengths: planes only, so that each word lies in one cell and any word can be routed."""

    def __init__(self, sample: list[str], share: float, cell: int):
        self.trees = {}
        by_length: dict[int, list[str]] = {}
        for w in sample:
            by_length.setdefault(len(w), []).append(w)
        for length, words in by_length.items():
            self.trees[length] = self._split(_vectors(_letters(words)), max(4, round(cell * share)), "")

    def _split(self, points: np.ndarray, leaf: int, name: str):
        plane = _plane(points, points.min(0), points.max(0)) if len(points) > leaf else None
        if plane is None:
            return name
        side = points[:, plane[0]] >= plane[1]
        return (*plane, self._split(points[~side], leaf, name + "0"), self._split(points[side], leaf, name + "1"))

    def cells(self, length: int, points: np.ndarray, reach: int) -> Iterator[tuple[str, np.ndarray]]:
        """Name of each cell of a length and the rows of points that are within reach of it (0: that lie in it)."""
        stack = [(self.trees.get(length, ""), np.arange(len(points)), {}, np.zeros(len(points), np.int64))]
        while stack:
            node, rows, bounds, _ = stack.pop()
            if not len(rows):
                continue
            if isinstance(node, str):
                yield f"{length}:{node}", rows
                continue
            d, cut, low, high = node
            for below, limits in ((low, (None, cut - 1)), (high, (cut, None))):
                old = bounds.get(d, (None, None))
                own = bounds | {d: tuple(new if new is not None else o for new, o in zip(limits, old, strict=True))}
                spent = np.zeros(len(rows), np.int64)
                for k, (least, most) in own.items():
                    v = points[rows, k]
                    if least is not None:
                        spent += np.maximum(least - v, 0)
                    if most is not None:
                        spent += np.maximum(v - most, 0)
                ok = spent <= reach
                stack.append((below, rows[ok], own, spent[ok]))


def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """a, n_a, b, n_b for words (word, n; distinct) one edit apart, each pair once in each direction."""
    total = words.count()
    rate = min(1.0, sample / max(1, total))
    chosen = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(rate * (1 << 20)))
    upper = Upper([r["word"] for r in chosen.select("word").limit(2 * sample).collect()], rate, cell)

    def routed(batches):
        for batch in batches:
            texts, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            by_length: dict[int, list[int]] = {}
            for i, w in enumerate(texts):
                by_length.setdefault(len(w), []).append(i)
            for length, at in by_length.items():
                points, at = _vectors(_letters([texts[i] for i in at])), np.array(at)
                home = np.empty(len(at), object)
                for name, rows in upper.cells(length, points, 0):
                    home[rows] = name
                    yield _rows(name, 0, texts, counts, at[rows])
                for name, rows in upper.cells(length, points, 2):
                    rows = rows[home[rows] < name]  # of two cells the later one has the visit
                    yield _rows(name, 1, texts, counts, at[rows])
                for name, rows in upper.cells(length - 1, points, 1):  # the longer word visits the shorter
                    yield _rows(name, 2, texts, counts, at[rows])

    def searched(table: pa.Table) -> pa.Table:
        role, texts, counts = table["role"].to_numpy(), np.array(table["word"].to_pylist(), object), table["n"].to_numpy()
        home = np.flatnonzero(role == 0)
        found = []
        if len(home):
            own = texts[home].tolist()
            tree = Tree(_vectors(_letters(own)), LEAF)
            for kind, reach in ((0, 2), (1, 2), (2, 1)):
                other = np.flatnonzero(role == kind)
                for i, j in near_pairs(own, texts[other].tolist(), reach, tree):
                    if kind == 0:
                        i, j = i[i < j], j[i < j]
                    found.append((home[i], other[j]))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        return pa.table([pa.array(texts[a].tolist(), pa.string()), pa.array(counts[a]), pa.array(texts[b].tolist(), pa.string()), pa.array(counts[b])], ["a", "n_a", "b", "n_b"])

    dealt = words.select("word", "n").mapInArrow(routed, "cell string, role int, word string, n long")
    return dealt.groupBy("cell").applyInArrow(searched, "a string, n_a long, b string, n_b long")


def _rows(name: str, role: int, texts: list[str], counts: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([name] * len(at), pa.string()), pa.array(np.full(len(at), role, np.int32)), pa.array([texts[i] for i in at.tolist()], pa.string()), pa.array(counts[at])]
    return pa.RecordBatch.from_arrays(columns, ["cell", "role", "word", "n"])


def spelling_groups(documents: DataFrame, shortest: int = 6, least: int = 5, times: int = 5, every: int = 0, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """Words of all documents with their usual spelling: word, n, n_near, form, form_n, root.

    Words are runs of letters (A-Z and À-ÿ, A-Z lower-cased) of at least `shortest` letters that occur `least` times.
    n_near: how many words are one inserted, deleted or replaced letter away. form: the most frequent of them (ties: the
    smallest in code-point order), if it occurs at least `times` times as often, else null. root: the last word on the way
    from form to form. `every`: see `variants`. Null texts are empty; repeated rows fold into one (`keyed`), a null doc_id
    is a document of its own; a table without words gives an empty result. Other columns are ignored.
    """
    counts = variants(keyed(documents), every, shortest).groupBy("word").agg(F.sum("n").alias("n"))
    words = stored(counts.where(F.col("n") >= least))
    near = near_words(words, sample, cell)
    best = near.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("word"))).alias("best")).withColumnRenamed("a", "word")
    usual = F.col("n_best") >= times * F.col("n")
    known = words.join(best.select("word", "n_near", F.col("best.word").alias("b"), (-F.col("best.n")).alias("n_best")), "word", "left")
    known = stored(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(usual, F.col("b")).alias("form"), F.when(usual, F.col("n_best")).alias("form_n")))

    # each step of a way is `times` as frequent, so ways are short; a round doubles what is known of them
    way = stored(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        longer = way.alias("x").join(way.select(F.col("word").alias("root"), F.col("root").alias("above")), "root", "left")
        longer = stored(longer.select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        way = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return known.join(way, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
