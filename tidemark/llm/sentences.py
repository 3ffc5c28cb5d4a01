"""Piece encoding by vectorised merge rounds, and decoding.

All distinct words of a block lie in one flat symbol array. A round finds the pair of smallest rank in each word (a
segmented minimum) and merges it in all words at once, leftmost first; then the arrays are compacted. Words in which no
pair is left drop out. Where a merge could enable a better pair at once, only the leftmost is made in that round, so the
result is that of merging one pair at a time.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import blocks, keyed, plain_id
from tidemark.llm.vocab import Table

SPACE_MARK = "▁"
NONE = np.int64(2**62)
_UNKNOWN = (1 << 31) - 1


class Pieces:
    """Vocabulary of a model file: pairs that merge, ranks, and ids of the rest."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.bytes = np.full(256, sp.unk_id(), np.int64)
        for i in range(size):
            if sp.is_byte(i):
                self.bytes[int(names[i][3:5], 16)] = i
        self.number = {names[i]: i for i in plain}
        if any(SPACE_MARK in n.lstrip(SPACE_MARK) for n in self.number):
            raise ValueError("a piece has a space after other characters; words cannot be encoded one by one")
        self.size = size
        self.chars = {c: self.number.get(c, size + k) for k, c in enumerate(sorted({c for n in self.number for c in n}))}
        self.texts = {v: c for c, v in self.chars.items() if v >= size}
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        of = lambda t: self.chars.get(t) if len(t) == 1 else self.number.get(t)
        pairs = {}
        for name, i in self.number.items():
            for cut in range(1, len(name)):
                left, right = of(name[:cut]), of(name[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = (rank[i], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [NONE], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()] + [-1], np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among those that merge; the last place means none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, len(self.keys))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of words in normal form (spaces as marks)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points, place = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), return_inverse=True)
        # characters outside the vocabulary get numbers that are in no pair
        numbers = [self.chars.get(chr(c), _UNKNOWN - c) for c in points.tolist()]
        symbols = np.array(numbers, np.int64)[place]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        none = len(self.keys)
        pair = np.full(len(symbols), none)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pair[inside] = self.pair(symbols[inside], symbols[inside + 1])
        while len(symbols):
            rank = self.ranks[pair]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.append(first, len(symbols)))
            least = np.minimum.reduceat(rank, first)
            over = np.repeat(least == NONE, sizes)
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                open_ = ~over
                symbols, owner, pair, rank = symbols[open_], owner[open_], pair[open_], rank[open_]
                sizes, least = sizes[least != NONE], least[least != NONE]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            # of a chain of equal symbols every second, leftmost first
            follows = np.r_[False, hit[1:] == hit[:-1] + 1]
            if follows.any():
                since = np.arange(len(hit)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(hit))))
                hit = hit[since % 2 == 0]
            own = owner[hit]
            again = np.r_[False, own[1:] == own[:-1]]
            if again.any():
                several = np.isin(own, own[again])
                at = hit[several]
                made, limit = self.merged[pair[at]], rank[at]
                better = (self.ranks[self.pair(symbols[np.maximum(at - 1, 0)], made)] < limit) | (self.ranks[self.pair(made, symbols[np.minimum(at + 2, len(symbols) - 1)])] < limit)
                better |= self.ranks[self.pair(made, made)] < limit
                hit = hit[~(again & np.isin(own, own[several][better]))]
            symbols[hit] = self.merged[pair[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))  # places after compaction
            symbols, owner, pair = symbols[keep], owner[keep], pair[keep]
            changed = np.concatenate([moved, moved[moved > 0] - 1])
            last = changed + 1 >= len(symbols)
            after = np.minimum(changed + 1, len(symbols) - 1)
            pair[changed] = np.where(~last & (owner[changed] == owner[after]), self.pair(symbols[changed], symbols[after]), none)
        if not done_symbols:
            return np.zeros(0, np.int64), lengths
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        symbols, owner = symbols[order], owner[order]
        strange = np.flatnonzero(symbols >= self.size)
        if len(strange):  # characters without a piece become their bytes
            parts = [self.bytes[list((self.texts.get(s) or chr(_UNKNOWN - s)).encode())] for s in symbols[strange].tolist()]
            size = np.ones(len(symbols), np.int64)
            size[strange] = [len(p) for p in parts]
            out = np.repeat(symbols, size)
            begin = np.cumsum(size) - size
            for at, p in zip(begin[strange].tolist(), parts, strict=True):
                out[at : at + len(p)] = p
            symbols, owner = out, np.repeat(owner, size)
        return symbols, np.bincount(owner, minlength=len(words))


@functools.cache
def pieces(path: str) -> tuple[Pieces, Table]:
    model = Pieces(path)
    words = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+").findall

    def encode_pieces(new, _):
        # a piece is a part between spaces; those of the slow path are in normal form and begin with a mark; a line end is in no piece, so what follows it stands alone
        new = new.to_pylist()
        unsafe = np.array([not p or SPACE_MARK in p for p in new], bool)
        return *model.encode_words([p if p[:1] in (SPACE_MARK, "\n") else SPACE_MARK + p for p in new]), unsafe

    def parts(text):
        return words(SPACE_MARK + text.replace(" ", SPACE_MARK))

    if any("\n" in n for n in model.number):
        raise ValueError("a piece holds a line end; texts cannot be cut there")
    return model, Table(encode_pieces, parts)


SCHEMA = "doc_id long, ids array<int>, decoded string"


def encode_decode(documents: DataFrame, path: str) -> DataFrame:
    """Piece ids with begin and end ids, and the text that they decode to: doc_id, ids, decoded.

    Null and empty texts have the begin and end id only; repeated rows fold into one (`keyed`); an empty table gives an
    empty result. `path` must exist on every executor.
    """

    def rows(batches):
        model, table = pieces(path)
        sp = model.library
        for batch in batches:
            for block in blocks([batch]):
                ids, counts = table.encode(block.column("text").to_pylist())
                ends = np.cumsum(counts)
                lists = [[sp.bos_id(), *ids[e - c : e].tolist(), sp.eos_id()] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(lists, pa.list_(pa.int32())), pa.array([sp.decode(x) for x in lists])], ["doc_id", "ids", "decoded"])

    return keyed(documents).mapInArrow(rows, SCHEMA).select(plain_id(), "ids", "decoded")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit integers) and decoded_sha256."""

    def rows(batches):
        model, table = pieces(path)
        sp = model.library
        for batch in batches:
            for block in blocks([batch]):
                ids, counts = table.encode(block.column("text").to_pylist())
                ends = np.cumsum(counts).tolist()
                out = []
                for e, c in zip(ends, counts.tolist(), strict=True):
                    own = np.concatenate([[sp.bos_id()], ids[e - c : e], [sp.eos_id()]]).astype("<u4")
                    out.append((c + 2, hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(sp.decode(own.tolist()).encode()).hexdigest()))
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(pa.array(x) for x in zip(*out, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return keyed(documents).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").select(plain_id(), "n_tokens", "ids_sha256", "decoded_sha256")
