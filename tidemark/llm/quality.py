"""Quality rules over whole texts, with repetition measured on a suffix array of words.

The suffix array of each text is built by prefix doubling, for all texts of a block at once; only suffixes that still tie
are sorted again. The ranks of each round give the longest common prefix of neighbours, so the intervals of long common
prefixes, hence all maximal repeated word strings, are read off without comparing words again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import SPACE, blocks, flat, keyed, plain_id, word_hashes, words_of

SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1


def repeated_prefixes(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """For each place: length of the longest string of values that starts there and elsewhere in the same text."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    texts = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    stop = firsts[1:][texts]
    order = np.lexsort((values, texts))
    new = np.ones(n, bool)
    new[1:] = (values[order][1:] != values[order][:-1]) | (texts[order][1:] != texts[order][:-1])
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = heads
    levels, step = [rank], 1
    while True:
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        own = order[at]
        after = own + step
        second = np.where(after < stop[own], rank[np.minimum(after, n - 1)], -1)
        sort = np.lexsort((second, rank[own]))
        own, second = own[sort], second[sort]
        order[at] = own
        split = np.ones(len(at), bool)
        split[1:] = (rank[own][1:] != rank[own][:-1]) | (second[1:] != second[:-1])
        new[at] = split
        rank = rank.copy()
        rank[own] = np.maximum.accumulate(np.where(split, at, 0))
        levels.append(rank)
        step *= 2
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for h in range(len(levels) - 1, -1, -1):
        inside = (left < n) & (right < n)
        equal = np.zeros(n - 1, bool)
        equal[inside] = levels[h][left[inside]] == levels[h][right[inside]]
        common += equal << h
        left += equal << h
        right += equal << h
    longest = np.zeros(n, np.int64)
    longest[order[1:]] = common
    longest[order[:-1]] = np.maximum(longest[order[:-1]], common)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Places inside a repeated string of `least` values or more."""
    at = np.flatnonzero(longest >= least)
    change = np.zeros(len(longest) + 1, np.int64)
    change[at] += 1
    np.subtract.at(change, at + longest[at], 1)
    return np.cumsum(change[:-1]) > 0


def _per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[ends[1:]] - sums[ends[:-1]]


def _max_per_text(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(firsts) - 1, np.int64)
    some = np.flatnonzero(np.diff(firsts))
    if len(some):
        out[some] = np.maximum.reduceat(values, firsts[some])
    return out


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, base_failed boolean, kept boolean"


def quality(documents: DataFrame, min_words: int = 20, window: int = 8, max_percent: int = 30, min_repeat: int = 20, max_covered_percent: int = 20, max_repeat: int = 100) -> DataFrame:
    """Figures and verdict per document.

    Base: at least `min_words` words, and at most `max_percent` percent of them in `window`-word strings that the text
    has twice or more. Method: the union of maximal repeated strings of `min_repeat` words or more covers at most
    `max_covered_percent` percent of the words, and none is longer than `max_repeat` words.

    Null and empty texts have no words and fail the base. Lines without a word never count as repeated. Repeated rows
    fold into one (`keyed`); an empty table gives an empty result.
    """

    def rows(batches):
        for batch in batches:
            for block in blocks([batch]):
                data, ends = flat(block.column("text"))
                starts, stops, firsts = words_of(data, ends)
                longest = repeated_prefixes(word_hashes(data, starts, stops), firsts)
                n = np.diff(firsts)
                letters = _per_text(((data & 0xC0) != 0x80) & ~SPACE[data], ends)
                repeats = _per_text(covered(longest, window), firsts)
                union, most = _per_text(covered(longest, min_repeat), firsts), _max_per_text(longest, firsts)
                lines = [_repeated_lines(t.as_py()) for t in block.column("text").cast(pa.binary())]
                failed = (n < min_words) | (100 * repeats > max_percent * n)
                kept = ~failed & (100 * union <= max_covered_percent * n) & (most <= max_repeat)
                figures = (n, letters, _per_text(SYMBOLS[data], ends), np.array(lines), repeats, union, most)
                columns = [block.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in figures), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    out = keyed(documents).mapInArrow(rows, SCHEMA)
    return out.select(plain_id(), *out.columns[1:])


def _repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))
