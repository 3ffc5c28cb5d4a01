"""Helpers of the text operators: inputs with defined keys, flat arrays over Arrow strings, hashed windows.

Texts stay UTF-8 in Arrow buffers. A task works through its rows in blocks of about `BLOCK` bytes, so its memory
depends on the longest text, never on the number of rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import durable

BLOCK = 1 << 20
NO_ID = -(2**63)  # stands for a null doc_id inside the operators

U = np.uint64
_WORD_BASE, _TEXT_BASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id (long, never null) and text (string, never null), one row per id.

    A null text is empty, a null id is one id of its own. Rows that share an id fold into the one with the greatest
    text; repeated rows are therefore one row. Other columns are ignored, so their names cannot clash.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    repeated = rows.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return rows.groupBy("doc_id").agg(F.max("text").alias("text")) if repeated else rows


def plain_id(column="doc_id"):
    """The id as given: null again where it was null."""
    return F.when(F.col(column) != NO_ID, F.col(column)).alias("doc_id")


def partitions(spark: SparkSession) -> int:
    """Number of parts that a shuffle deals out to; the session sizes it to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: later steps need not derive it anew."""
    return durable(df)


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets_of(batch.column("text"))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, and where each begins (one more at the end)."""
    ends, data = offsets_of(column), column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(data: np.ndarray, ends: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (run of bytes not `outside`), and where each text's words begin (one more at the end)."""
    full = ~outside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    first, last = full.copy(), full.copy()
    if len(data):
        first[1:] &= ~full[:-1] | edge[1:-1]
        last[:-1] &= ~full[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, ends)


@functools.lru_cache(8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, U), np.full(n, pow(base, -1, 2**64), U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n at least."""
    return _powers(int(base), 1 << max(10, int(n).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTES = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits per word, mixed from eight bytes at a time; long words by XXH64.

    A polynomial modulo 2**64 would give some words of regular structure one hash, whatever its base.
    """
    lengths = stops - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = mixed(lengths.astype(U) + U(seed << 56) + _WORD_BASE)
    words, done = np.flatnonzero(lengths <= LONG_WORD), 0
    while len(words):
        left = lengths[words] - done
        part = eight[starts[words] + done]
        part &= ~U(0) >> (U(64) - U(8) * np.minimum(left, 8).astype(U))
        out[words] = mixed(out[words] * _TEXT_BASE + part)
        words, done = words[left > 8], done + 8
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : stops[i]].tobytes(), seed)
    return out


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each `width` consecutive values; windows that cross texts are there too."""
    if len(values) < width:
        return np.zeros(0, U)
    up, down = powers(_TEXT_BASE, len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * down[: len(values) - width + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def inner(firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows over all values: those within one text. firsts: where each text's values begin (one more at the end).

    Returns their places and how many each text has.
    """
    counts = np.maximum(np.diff(firsts) - width + 1, 0)
    return expand(firsts[:-1], counts), counts


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then the same for the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - skip, counts)


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)
