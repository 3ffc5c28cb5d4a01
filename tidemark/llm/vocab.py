"""Token ids of whole texts from a table of their pieces.

Byte-level BPE never joins a space with what stands before it, and piece BPE never joins a space into the middle of a
piece. Texts are therefore cut before single spaces and line ends, each distinct piece is encoded once in a worker, and the
ids of a text are gathered from the table. When the table has grown to `LIMIT` pieces (about 80 bytes each), the half used
most stays, so memory is bounded.
"""

from __future__ import annotations

import functools
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import expand, flat, word_hashes

LIMIT = 800_000
PLAIN = re.compile(r"\n?\S+")  # pieces with white space only before them
LETTERS = [chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)] if c not in (0xD7, 0xF7)]
WORD = r"\A\n?[A-Za-zÀ-ÖØ-öø-ɏ]+\z"  # of these letters
SIGNS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
SPACE = "Ġ"  # a space in the names of byte-level tokens


class _Places:
    """Places of 64-bit keys in a flat table; a place is the number of its key. Of equal keys the first is found."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.slots = keys[:0], np.full(1 << 12, -1, np.int32)
        self.add(keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        places = np.arange(len(self.keys), len(self.keys) + len(keys), dtype=np.int32)
        self.keys = np.append(self.keys, keys)
        if 2 * len(self.keys) > len(self.slots):
            self.slots = np.full(1 << (2 * len(self.keys)).bit_length(), -1, np.int32)
            places, keys = np.arange(len(self.keys), dtype=np.int32), self.keys
        at = self._slot(keys)
        while len(places):
            free = self.slots[at] < 0
            self.slots[at[free][::-1]] = places[free][::-1]
            left = self.slots[at] != places
            places, at = places[left], (at[left] + 1) & (len(self.slots) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if there is none."""
        out, at, left = np.full(len(keys), -1, np.int32), self._slot(keys), np.arange(len(keys))
        while len(left):
            place = self.slots[at]
            same = (place >= 0) & (self.keys[place] == keys) if len(self.keys) else place >= 0
            out[left[same]] = place[same]
            on = np.flatnonzero((place >= 0) & ~same)
            left, at, keys = left[on], (at[on] + 1) & (len(self.slots) - 1), keys[on]
        return out


class Table:
    """Ids by piece. encode_pieces(pieces, which of them stand after a space) gives flat ids, counts, and which pieces are unsafe.

    A text with an unsafe piece is cut by `split` instead. parts(pieces) gives the places of pieces of two parts without
    white space between them, whose ids in turn are those of the piece, and both parts of each; so a part is encoded once
    for all such pieces. Pieces are Arrow strings, found by their hashes and then compared; numbers and ids are flat arrays.
    """

    def __init__(self, encode_pieces, split, parts=lambda pieces: (np.zeros(0, np.int64), pieces[:0], pieces[:0])):
        self.encode_pieces, self.split, self.parts = encode_pieces, split, parts
        self.clear()

    def clear(self) -> None:
        self.n, self.new = 0, []
        self.pieces, self.spaced, self.places = pa.array([], pa.large_string()), np.zeros(0, bool), _Places(np.zeros(0, np.uint64))
        self.ids, self.starts, self.counts, self.unsafe, self.uses = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def first(self) -> pa.Array:
        """Known pieces that begin a text or follow another part."""
        return self.pieces.filter(pa.array(~self.spaced))

    @property
    def rest(self) -> pa.Array:
        """Known pieces after a space."""
        return self.pieces.filter(pa.array(self.spaced))

    def trim(self, most: int = LIMIT // 2) -> None:
        """Leaves the pieces used most, and none that was used once; older uses count half from then on."""
        stay = np.sort(np.argsort(-self.uses, kind="stable")[:most])
        stay = stay[self.uses[stay] > 1]
        self.n, self.ids = len(stay), self.ids[expand(self.starts[stay], self.counts[stay])]
        self.pieces, self.spaced, self.places = self.pieces.take(pa.array(stay)), self.spaced[stay], _Places(self.places.keys[stay])
        self.counts, self.unsafe, self.uses = self.counts[stay], self.unsafe[stay], self.uses[stay] // 2
        self.starts = np.cumsum(self.counts, dtype=np.int64) - self.counts

    def _find(self, pieces: pa.Array, spaced: bool) -> np.ndarray:
        """Number of each of some different pieces; new ones are listed."""
        data, ends = flat(pieces)
        keys = word_hashes(data, ends[:-1], ends[1:], int(spaced))
        places = self.places.find(keys)
        known = np.flatnonzero(places >= 0)
        same = _mask(pc.equal(pieces.take(pa.array(known)), self.pieces.take(pa.array(places[known])))) & (self.spaced[places[known]] == spaced)
        places[known[~same]] = -1
        lost = np.flatnonzero(places < 0)
        if len(lost):
            fresh = pieces.take(pa.array(lost))
            places[lost] = np.arange(self.n, self.n + len(lost))
            self.n += len(lost)
            self.new.append((fresh, spaced))
            self.places.add(keys[lost])
            self.pieces, self.spaced = pa.concat_arrays([self.pieces, fresh]), np.append(self.spaced, np.full(len(lost), spaced))
        return places

    def _find_all(self, pieces: pa.Array, spaced: bool) -> np.ndarray:
        """The same for pieces of which some may be equal."""
        coded = pieces.dictionary_encode()
        return self._find(coded.dictionary, spaced)[coded.indices.to_numpy()]

    def _listed(self) -> tuple[pa.Array, np.ndarray]:
        """New pieces in the order of their numbers, and which stand after a space; none is listed from then on."""
        new, self.new = self.new, []
        return pa.concat_arrays([pa.array([], pa.large_string()), *(p for p, _ in new)]), np.repeat(np.array([s for _, s in new], bool), [len(p) for p, _ in new])

    def _learn(self) -> None:
        if not self.new:
            return
        old = len(self.counts)
        pieces, spaced = self._listed()
        made, lefts, rights = self.parts(pieces)
        halves = np.zeros((len(made), 2), np.int64)
        for after in (False, True):
            own = np.flatnonzero(spaced[made] == after)
            halves[own, 0] = self._find_all(lefts.take(pa.array(own)), after)
        halves[:, 1] = self._find_all(rights, False)
        more, more_spaced = self._listed()  # parts not known yet come after the others
        pieces, spaced = pa.concat_arrays([pieces, more]), np.append(spaced, more_spaced)
        simple = np.ones(len(pieces), bool)
        simple[made] = False
        simple = np.flatnonzero(simple)
        ids, counts, unsafe = self.encode_pieces(pieces.take(pa.array(simple)), spaced[simple])
        grown = np.zeros(len(pieces), np.int32)
        self.counts, self.starts, self.uses = np.append(self.counts, grown), np.append(self.starts, grown), np.append(self.uses, grown)
        self.unsafe = np.append(self.unsafe, grown > 0)
        at = old + simple
        self.starts[at], self.counts[at], self.unsafe[at] = len(self.ids) + np.cumsum(counts) - counts, counts, unsafe
        self.ids = np.append(self.ids, ids.astype(np.int32))
        if len(made):
            sizes = self.counts[halves].ravel()
            ids, counts = self.ids[expand(self.starts[halves].ravel(), sizes)], sizes[::2] + sizes[1::2]
            at = old + made
            self.starts[at], self.counts[at] = len(self.ids) + np.cumsum(counts) - counts, counts
            self.ids = np.append(self.ids, ids)
            self.uses += np.bincount(halves.ravel(), minlength=self.n)

    def _numbers(self, pieces: pa.Array, begins: np.ndarray) -> np.ndarray:
        """Numbers of the pieces of texts that begin at these places; a piece is looked up once a call."""
        coded = pieces.dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_string())
        heads = codes[begins]
        number = np.zeros(len(names), np.int64)
        some = np.flatnonzero(np.bincount(codes, minlength=len(names)) > np.bincount(heads, minlength=len(names)))
        number[some] = self._find(names.take(pa.array(some)), True)
        numbers = number[codes]
        some = np.unique(heads)
        number[some] = self._find(names.take(pa.array(some)), False)
        numbers[begins] = number[heads]
        return numbers

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and how many each has."""
        if self.n > LIMIT:
            self.trim()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        totals = np.zeros(len(texts), np.int64)
        some = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        if not len(some):
            return np.zeros(0, np.int32), totals
        if len(some) < len(texts):
            texts = texts.take(pa.array(some))
        lists = texts.cast(pa.large_string()) if texts.nbytes >= 1 << 30 else texts  # line ends grow by a space
        lists = pc.split_pattern(pc.replace_substring(lists, "\n", " \n"), " ")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        places = self._numbers(lists.flatten(), begins)
        del lists
        self._learn()
        odd = np.logical_or.reduceat(self.unsafe[places], begins)
        if odd.any():
            again = [self.split(texts[i].as_py()) for i in np.flatnonzero(odd).tolist()]
            fresh = sizes.copy()
            fresh[odd] = list(map(len, again))
            again = self._numbers(pa.array(list(chain.from_iterable(again)), pa.large_string()), np.cumsum(fresh[odd]) - fresh[odd])
            self._learn()
            at = np.cumsum(fresh) - fresh
            all_places = np.zeros(int(fresh.sum()), np.int64)
            all_places[expand(at[~odd], sizes[~odd])] = places[expand(begins[~odd], sizes[~odd])]
            all_places[expand(at[odd], fresh[odd])] = again
            places, begins = all_places, at
        self.uses += np.bincount(places, minlength=self.n)
        counts = self.counts[places]
        totals[some] = np.add.reduceat(counts, begins)
        return self.ids[expand(self.starts[places], counts)], totals


@functools.cache
def byte_bpe(path: str) -> Table:
    """Table over a byte-level BPE file of the tokenizers library; special tokens in texts count as the library has it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)

    line_end = tokenizer.encode("\n", add_special_tokens=False).ids
    if len(line_end) != 1:
        raise ValueError("a line end is not one token")
    vocabulary = tokenizer.get_vocab()
    after_line = np.zeros(max(vocabulary.values()) + 1, bool)
    after_line[line_end[0]] = True
    after_space = np.zeros(len(after_line), bool)
    after_space[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True

    # letters and the signs after them never share a token, if the file cuts texts there
    shown = lambda text: [t for t, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
    cuts = tokenizer.normalizer is None and tokenizer.pre_tokenizer is not None and shown("ab,.!") == ["ab", ",.!"]
    # words of letters alone are one part of a text each: the library's model gets them as such, in the characters that stand for their bytes
    sample = " " + "".join(LETTERS)
    whole = shown(sample) if cuts else []
    symbols = np.zeros(256, np.uint32)
    if len(whole) == 1 and len(whole[0]) == len(sample.encode()):
        symbols[list(sample.encode())] = list(map(ord, whole[0]))
        symbols[0x0A] = ord(shown("\n")[0])
    bare = symbols.any() and _spelled(symbols, sample) == whole[0] and shown("\nab") == [_spelled(symbols, "\n"), "ab"]
    bare = bare and all(set(t.content) - set(LETTERS) for t in tokenizer.get_added_tokens_decoder().values())
    model = Tokenizer(tokenizer.model)
    model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\0")

    def begun(text, library, begins, n):
        """Ids of a text of n pieces, and where each begins."""
        ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        starts = np.flatnonzero(begins[ids])
        if len(starts) != n:
            raise ValueError("the tokens of a piece cannot be told from the next")
        return ids, starts

    def encode_pieces(names, after):
        # pieces without white space are encoded in one go; the space or line end before each tells where it begins
        pieces = names.to_numpy(zero_copy_only=False)
        words = _mask(pc.match_substring_regex(names, WORD)) if bare else np.zeros(len(pieces), bool)
        lines = _mask(pc.starts_with(names, "\n"))
        spaced = after & ~lines
        easy = words.copy()
        easy[~words] = [bool(PLAIN.fullmatch(p)) for p in pieces[~words].tolist()]
        counts = np.zeros(len(pieces), np.int64)
        found, order = [], []
        for mark, begins, own, chosen in ((" ", after_space, True, spaced), ("\n", after_line, True, lines), ("\n", after_line, False, ~spaced & ~lines)):
            for plain in (True, False):
                at = np.flatnonzero(easy & chosen & (words == plain))
                for begin in range(0, len(at), 20_000):
                    some = at[begin : begin + 20_000]
                    parts = pieces[some].tolist()
                    if not plain:
                        text = "".join(parts) if mark == "\n" and own else mark + mark.join(parts)
                    elif mark == " ":
                        text = " " + "\0 ".join(parts)
                    else:
                        text = "\0".join(parts).replace("\n", "\n\0") if own else "\n\0" + "\0\n\0".join(parts)
                    ids, starts = begun(_spelled(symbols, text) if plain else text, model if plain else tokenizer, begins, len(some))
                    counts[some] = np.diff(np.append(starts, len(ids))) - (not own)
                    found.append(ids if own else np.delete(ids, starts))
                    order.append(some)
        at = np.concatenate([*order, np.zeros(0, np.int64)])
        hard = np.flatnonzero(~easy)
        alone = [e.ids for e in tokenizer.encode_batch_fast([" " + pieces[i] if spaced[i] else pieces[i] for i in hard.tolist()], add_special_tokens=False)]
        counts[hard] = np.fromiter(map(len, alone), np.int64, len(alone))
        out = np.zeros(int(counts.sum()), np.int32)
        starts = np.cumsum(counts) - counts
        out[expand(starts[at], counts[at])] = np.concatenate([*found, np.zeros(0, np.int32)])
        out[expand(starts[hard], counts[hard])] = np.fromiter(chain.from_iterable(alone), np.int32)
        unsafe = np.zeros(len(pieces), bool)
        unsafe[hard] = [open_(pieces[i], after[i]) for i in hard.tolist()]
        return out, counts, unsafe

    def open_(piece, spaced):
        # a line end may begin a piece, with the text after it at once
        return not piece or piece[-1].isspace() or spaced and piece[0].isspace() and (piece[0] != "\n" or piece[1].isspace())

    def parts(pieces):
        lefts = pc.ascii_rtrim(pieces, SIGNS)
        made = np.flatnonzero(_mask(pc.less(pc.binary_length(lefts), pc.binary_length(pieces))))
        made = made[_mask(pc.match_substring_regex(lefts.take(pa.array(made)), WORD))]
        at = pa.array(made)
        return made, lefts.take(at), pc.utf8_ltrim(pieces.take(at), "\n" + "".join(LETTERS))

    split = re.compile(r"(?<=\S) (?=\S)").split
    return Table(encode_pieces, split, parts) if cuts else Table(encode_pieces, split)


def _mask(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False)


def _spelled(symbols: np.ndarray, text: str) -> str:
    """A text with a character for each of its bytes."""
    return symbols[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")
