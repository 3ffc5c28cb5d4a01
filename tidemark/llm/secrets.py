"""Secrets in texts: fixed patterns, and strings that a tokenizer finds hard.

A vocabulary covers ordinary words with few tokens. A long string of letters, digits and key characters that needs many
tokens for its length is random, so likely a key. Digests, UUIDs, numbers and identifiers made of words are left out.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import blocks, flat, keyed, plain_id, words_of

KINDS = ("assign", "access", "hex", "random")
# fixed patterns of the base rules
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

NOT_HEX = np.ones(256, bool)
NOT_HEX[[ord(c) for c in "0123456789abcdef"]] = False
NOT_KEY = np.ones(256, bool)
NOT_KEY[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "+/_=-")]] = False
DIGEST = re.compile(rb"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
UUID = re.compile(rb"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
IDENTIFIER = re.compile(rb"(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)[+/_=-]+)*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)[+/_=-]*")
LETTERS = re.compile(rb"[A-Za-z]+")
MIN_RANDOM, MAX_RATIO = 20, 2.2


@functools.cache
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _long_runs(data: np.ndarray, ends: np.ndarray, outside: np.ndarray, least: int) -> list[list[tuple[int, int]]]:
    """Per text: start and end (bytes) of its runs of `least` bytes or more."""
    starts, stops, _ = words_of(data, ends, outside)
    long_ = stops - starts >= least
    starts, stops = starts[long_], stops[long_]
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(ends) - 1)]
    for t, a, b in zip((np.searchsorted(ends, starts, "right") - 1).tolist(), starts.tolist(), stops.tolist(), strict=True):
        out[t].append((a - int(ends[t]), b - int(ends[t])))
    return out


def is_random(run: bytes, path: str, max_ratio: float) -> bool:
    """Whether a run of key characters has few characters per token, and is no digest and no identifier made of words."""
    if DIGEST.fullmatch(run) or UUID.fullmatch(run):
        return False
    tokens = _encoding(path).encode_ordinary
    if IDENTIFIER.fullmatch(run):  # the shape alone does not make one: its letters must be words by the same measure
        words = [w.decode() for w in LETTERS.findall(run)]
        if sum(map(len, words)) >= max_ratio * sum(min(len(tokens(w)), len(tokens(" " + w))) for w in words):
            return False
    text = run.decode()
    return len(text) < max_ratio * len(tokens(text))


def spans_of(text: bytes, hex_runs, key_runs, path: str, max_ratio: float) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, in order."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if b"AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    base += [(a, 2, b) for a, b in hex_runs]
    base.sort()
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))

    def meets_base(a: int, b: int) -> bool:
        before = bisect_left(starts, b)
        return before > 0 and reach[before - 1] > a

    more = [(a, 3, b) for a, b in key_runs if not meets_base(a, b) and is_random(text[a:b], path, max_ratio)]
    return sorted(base + more)


def find_secrets(documents: DataFrame, path: str, min_random: int = MIN_RANDOM, max_ratio: float = MAX_RATIO) -> DataFrame:
    """doc_id, text, and spans (array of kind, start, end in code points; by start, then kind) of each document.

    `path` is a tiktoken rank file that every executor has. A run of `min_random` key characters is random if it has less
    than `max_ratio` characters per token; it is added unless it meets a base span. Null and empty texts have no spans;
    repeated rows fold into one (`keyed`); an empty table gives an empty result.
    """

    def rows(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for block in blocks([batch]):
                data, ends = flat(block.column("text"))
                hexes, keys = _long_runs(data, ends, NOT_HEX, MIN_HEX), _long_runs(data, ends, NOT_KEY, min_random)
                out = []
                for text, h, k in zip(block.column("text").cast(pa.binary()), hexes, keys, strict=True):
                    text = text.as_py()
                    found, at, points = [], 0, 0
                    marks = {}
                    spans = spans_of(text, h, k, path, max_ratio)
                    for place in sorted({p for a, _, b in spans for p in (a, b)}):
                        points += len(text[at:place].decode())
                        at = place
                        marks[place] = points
                    found = [{"kind": KINDS[n], "start": marks[a], "end": marks[b]} for a, n, b in spans]
                    out.append(found)
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("text"), pa.array(out, kind)], ["doc_id", "text", "spans"])

    found = keyed(documents).mapInArrow(rows, "doc_id long, text string, spans array<struct<kind:string,start:long,end:long>>")
    return found.select(plain_id(), "text", "spans")


def digests(found: DataFrame) -> DataFrame:
    """Counts of each base kind, the digest of the base spans, and all spans as text."""

    def rows(batches):
        for batch in batches:
            out = []
            for spans in batch.column("spans").to_pylist():
                named = [(f"{s['kind']}:{s['start']}:{s['end']}", s["kind"]) for s in spans]
                base = ",".join(n for n, k in named if k != "random")
                out.append((*(sum(k == kind for _, k in named) for kind in KINDS[:3]), hashlib.sha256(base.encode()).hexdigest(), ",".join(n for n, _ in named)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.select("doc_id", "spans").mapInArrow(rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_rows(documents: DataFrame, path: str, mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns as they are, with each union of overlapping spans in `text` replaced by `mask`.

    n_chars, where there is such a column, becomes the new length of a text that changed. Rows are worked through one by
    one, without keys: repeated rows and null ids stay, a null text stays null.
    """
    fields = [f for f in documents.schema if f.name == "n_chars"]

    def rows(batches):
        for batch in batches:
            for block in blocks([batch]):
                data, ends = flat(block.column("text"))
                hexes, keys = _long_runs(data, ends, NOT_HEX, MIN_HEX), _long_runs(data, ends, NOT_KEY, MIN_RANDOM)
                texts, sizes = [], []
                for i, (text, h, k) in enumerate(zip(block.column("text").cast(pa.binary()), hexes, keys, strict=True)):
                    text = text.as_py()
                    spans = spans_of(text, h, k, path, MAX_RATIO) if text else []
                    if spans:
                        out, at = [], 0
                        for start, _, end in spans:
                            if start >= at:
                                out += [text[at:start], mask.encode()]
                            at = max(at, end)
                        text = b"".join([*out, text[at:]])
                    texts.append(text)
                    if fields:
                        sizes.append(len(text.decode()) if spans else block.column("n_chars")[i].as_py())
                columns = dict(zip(block.schema.names, block.columns, strict=True))
                columns["text"] = pa.array(texts, pa.binary()).cast(pa.string())
                if fields:
                    columns["n_chars"] = pa.array(sizes, block.column("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return documents.mapInArrow(rows, documents.schema)
