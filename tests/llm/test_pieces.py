"""The piece table and the files of op4: words are learned once, whatever their hashes, and ids are digested where they are read."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import repair, vocab

BPE = public_tokenizers.path("byte_bpe_50k.json")


def _texts(r: random.Random, n: int) -> list[str]:
    letters = "abcdefghijklmnopqrstuvwxyzABCÀÉßéüøđŁǅɏ"
    words = ["".join(r.choices(letters, k=r.randint(1, 12))) for _ in range(60)] + ["×", "ª", "中文", "a1", "don't", "w" * 400]
    return ["".join(r.choice(words) + r.choice([" ", " ", "\n", ", ", ".\n", "  ", " \n"]) for _ in range(r.randint(0, 30))).strip("\n") for _ in range(n)]


def _same_as_library(table, texts):
    ids, counts = table.encode(texts)
    whole = [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, whole)) and ids.tolist() == sum(whole, [])


def test_words_of_letters_have_the_ids_of_whole_texts():
    table = vocab.byte_bpe(BPE)
    table.clear()
    every = " ".join(f"{a}{b}" for a, b in zip(vocab.LETTERS, vocab.LETTERS[1:], strict=False))
    _same_as_library(table, [every, every.replace(" ", "\n"), every.replace(" ", ",\n"), "ɏ", "", "\n", " ab", "\nab"])
    _same_as_library(table, _texts(random.Random(4), 200))
    table.clear()


def test_pieces_with_one_hash_are_told_apart(monkeypatch):
    table, hashes = vocab.byte_bpe(BPE), vocab.word_hashes
    table.clear()
    monkeypatch.setattr(vocab, "word_hashes", lambda *a: hashes(*a) & np.uint64(3))
    for seed in (5, 5, 6):
        _same_as_library(table, _texts(random.Random(seed), 10))
    table.clear()


def test_words_are_learned_once():
    """More words than the table held before, which then forgot most of them: 310,000, and again."""
    r, table = random.Random(7), vocab.byte_bpe(BPE)
    table.clear()
    texts = [" ".join("".join(r.choices("abcdefgh", k=9)) for _ in range(31_000)) for _ in range(10)]
    asked, learn = [], table.encode_pieces
    table.encode_pieces = lambda *new: asked.append(len(new[0])) or learn(*new)
    try:
        for _ in range(2):
            for text in texts:
                table.encode([text])
            asked.append(0)
    finally:
        table.encode_pieces = learn
        table.clear()
    assert sum(asked) <= len({w for t in texts for w in t.split(" ")}) + len(texts)


def test_ids_are_digested_where_they_are_read(spark, tmp_path):
    texts = dict(enumerate(_texts(random.Random(8), 40)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = repair.token_output(docs, BPE, str(tmp_path / "shards"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    library = Tokenizer.from_file(BPE)
    read = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in repair.read_shards(spark, str(tmp_path / "shards")).collect()}
    assert read == {d: [*library.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}


def test_grammar_of_any_sequence_gives_it_back():
    r = np.random.default_rng(9)
    for times in (1, 2, 5):
        for _ in range(30):
            ids = np.repeat(r.integers(0, r.integers(2, 9), r.integers(0, 3000)), times).astype(np.int32)
            for rules in (7, 1 << 15):
                assert (repair.expanded(*repair.compress(ids, max_rules=rules)) == ids).all()
