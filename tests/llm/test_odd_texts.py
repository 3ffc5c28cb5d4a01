"""Words of regular structure, broken tags, random identifiers, runs of one id, and texts longer than a block."""

import random
import time

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import html, quality, repair, secrets, simhash, substring, vocab
from tidemark.llm.common import BLOCK, NO_ID, word_hashes, words_of

RANKS, BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
THUE = "".join("ab"[i.bit_count() % 2] for i in range(1024))
MORSE = THUE.translate(str.maketrans("ab", "ba"))  # the same polynomial hash modulo 2**64, whatever the base


def _by_id(df):
    return {NO_ID if r[0] is None else r[0]: tuple(r)[1:] for r in df.collect()}


def test_words_of_regular_structure_have_different_hashes():
    text = f"{THUE} {MORSE} {THUE[:512]} {MORSE[:512]} a b ab ba {'a' * 70} {'a' * 71} {'a' * 70}".encode()
    data = np.frombuffer(text, np.uint8)
    starts, stops, _ = words_of(data, np.array([0, len(data)]))
    for seed in (0, 1):
        h = word_hashes(data, starts, stops, seed).tolist()
        assert len(set(h)) == len(h) - 1 and h[-1] == h[-3]
    assert set(word_hashes(data, starts, stops, 0).tolist()).isdisjoint(word_hashes(data, starts, stops, 1).tolist())


def test_regular_words_are_no_repeats(spark):
    r = random.Random(1)
    say = lambda n: [r.choice("pqrstu") * r.randint(1, 9) for _ in range(n)]
    left, right = say(12), say(12)
    texts = {1: " ".join([*left, THUE, *right]), 2: " ".join([*left, MORSE, *right]), 3: " ".join([*say(9), *left, THUE, *right])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert _by_id(substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))) == brute.remove_repeats(texts, 20)
    one = {7: " ".join([*left[:4], THUE, *right[:4], *left[:4], MORSE, *right[:4]])}
    got = {d: (v[0], v[4], v[5], v[6]) for d, v in _by_id(quality.quality(spark.createDataFrame(list(one.items()), "doc_id long, text string"))).items()}
    assert got == {7: brute.quality(one[7])} and got[7][1] == 0


def test_texts_longer_than_a_block(spark):
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    long_ = " ".join(r.choices(vocabulary, k=420_000))
    assert len(long_) > 2 * BLOCK
    middle = long_[BLOCK - 3000 : BLOCK + 3000].split(" ", 1)[1]
    texts = {1: "short one", 2: long_, 3: f"before {middle} after", 4: long_[BLOCK:] + " tail", 5: "x" * (BLOCK + 10), 6: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    assert _by_id(substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))) == brute.remove_repeats(texts, 20)
    prints = {d: v[0] for d, v in _by_id(simhash.near_duplicates(docs).select("doc_id", simhash.hex_of("fp"))).items()}
    assert prints[2] == brute.near_duplicates({2: long_})[2][0]
    assert _by_id(repair.token_output(docs, BPE)) == brute.token_output(texts, BPE)
    assert {d: v[:4] for d, v in _by_id(secrets.digests(secrets.find_secrets(docs, RANKS))).items()} == {d: brute.base_secrets(t) for d, t in texts.items()}


@pytest.mark.parametrize("page", ["<img " + '"' * 10_001 + "<p>x", "<p " + " ".join(f'a{i}="{i}"' for i in range(200)) + "<b>x", "<a " * 5000 + '"', "<a title='" + "\"'" * 5000, '<p x="' + "<" * 5000])
def test_broken_tags_take_linear_time(page):
    begin = time.time()
    html.flat_blocks(page)
    assert time.time() - begin < 2


def test_strings_in_tags_may_hold_brackets():
    texts, _ = html.flat_blocks("<article><p title=\"a > b\">one</p><p title='<x>'>two</p><figure><figcaption>three</figcaption></figure><p>2 <math><mi>x</mi></math></p></article>")
    assert texts == ["one", "two", "three", "2 x"]


def test_random_strings_shaped_like_identifiers():
    random_ones = [b"qzkxvbnmwrtplkjhgfdsqzxcvbnmwrtpkjhgfdsq", b"XKQZT-48213-PLMWV-90127", b"QZKXVBNMWRTPLKJHGFDSQZXCVB"]
    words = [b"a_long_identifier_of_words", b"internationalization", b"THE_LONG_CONSTANT_NAME", b"12345678901234567890", b"2024-01-02/some-article-title"]
    assert all(secrets.is_random(x, RANKS, secrets.MAX_RATIO) for x in random_ones)
    assert not any(secrets.is_random(x, RANKS, secrets.MAX_RATIO) for x in words)


def test_many_spans_in_one_text():
    text = b" ".join(b"token=%032x q7Zp2Kx9Vb4Tn8Lw3Rd6Yf1Hs5Jc0Mg%d" % (i, i) for i in range(4000))
    data = np.frombuffer(text, np.uint8)
    ends = np.array([0, len(data)])
    runs = [secrets._long_runs(data, ends, outside, least)[0] for outside, least in ((secrets.NOT_HEX, secrets.MIN_HEX), (secrets.NOT_KEY, secrets.MIN_RANDOM))]
    begin = time.time()
    spans = secrets.spans_of(text, *runs, RANKS, secrets.MAX_RATIO)
    assert time.time() - begin < 5 and [k for _, k, _ in spans].count(3) == 4000 and [k for _, k, _ in spans].count(0) == 4000


def test_runs_of_one_id_are_compressed():
    ids = np.array([*[9] * 100_000, 2, *[9] * 777, 2, *[5, 5, 6] * 400, 2], np.int32)
    sequence, rules, lengths, base = repair.compress(ids)
    assert len(sequence) < 700 and (repair.expanded(sequence, rules, lengths, base) == ids).all()


def test_piece_table_gives_the_ids_of_whole_texts(monkeypatch):
    """Any mix of white space, signs and letters, with a table that is full time and again."""
    table, library = vocab.byte_bpe(BPE), Tokenizer.from_file(BPE)
    monkeypatch.setattr(vocab, "LIMIT", 500)
    r = random.Random(3)
    signs = [*"ab'sABé ß \n\n\t  ,.!%1239　\xa0中\x85😀", "<|endoftext|>", "'re", "hello", "µm.", "x'", "\n\nword,"]
    for _ in range(100):
        texts = ["".join(r.choices(signs, k=r.randint(0, 40))) for _ in range(20)]
        ids, counts = table.encode(texts)
        whole = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, whole))
        assert ids.tolist() == sum(whole, [])
    table.trim(10)
    assert table.n <= 10 and len(table.first) + len(table.rest) == table.n
    table.clear()
