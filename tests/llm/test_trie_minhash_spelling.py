"""Conversation trie, MinHash and spelling variants against plain versions: nulls, ties, repeats, long rows, hot groups."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import contraction, minhash, modular, spelling, trie
from tidemark.llm.common import NO_ID

TURNS = "conv_id long, turn long, role string, text string, depth string, words string, a string, id string"


def _conversations():
    r = random.Random(7)
    openings = [[("user", "hello there"), ("assistant", "how can I help"), ("user", "tell me more")], [("system", ""), ("user", "x y z")]]
    rows = []
    for c in [*range(-25, 60), 400, 401, 10**12 + 3]:
        if c % 20 == 0 and c % 3:
            continue  # some bases are absent
        turns = r.choice(openings)[: r.randint(0, 3)] + [(r.choice(["user", "assistant"]), " ".join(r.choices("ab", k=r.randint(0, 3)))) for _ in range(r.randint(0, 4))]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(turns)]
    rows += [(41, i, "user", f"turn {i % 2}") for i in range(100, 700)]  # a long one, and one that shares its first half
    rows += [(42, i, "user", f"turn {i % 2}") for i in range(100, 400)]
    rows += [(7, None, "user", "no turn"), (7, None, None, "no turn"), (7, 3, "user", None), (7, 3, "user", None), (8, 0, None, None), (None, 1, "user", "nobody"), (9, 1, "user", "tie b"), (9, 1, "user", "tie a")]
    rows += [(c, i, "user", "same") for c in range(1000, 1300) for i in range(5)]  # a large group of copies
    return rows


def _trie(rows, spark, **conf):
    conv = F.col("conv_id")
    df = spark.createDataFrame([(*x, "d", "w", "a", "i") for x in rows], TURNS).repartition(5)
    return trie.prefix_trie(df, conv - F.pmod(conv, F.lit(20)), F.crc32(conv.cast("string").cast("binary")) % 4)


def test_trie_matches_plain_version(spark):
    rows = _conversations()
    assert any(r[0] is not None and r[0] - r[0] % 20 not in {x[0] for x in rows} for r in rows)
    got = sorted(map(tuple, _trie(rows, spark).collect()), key=repr)
    assert got == sorted(brute.prefix_trie([r for r in rows]), key=repr)


def test_trie_without_borrowing(spark):
    rows = [(1, 0, "u", "a b"), (1, 1, "u", "c"), (2, 0, "u", "a b"), (3, 0, "v", "a b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in trie.prefix_trie(df).collect()}
    assert got == {(1, 0): (None, 3, 2, 2, 2), (1, 1): (1, 2, 1, 1, 2), (1, 2): (1, 1, 0, 1, 0), (3, 1): (1, 1, 0, 1, 0)}
    assert trie.prefix_trie(df.limit(0)).collect() == []


def test_turnless_conversations_are_members_of_the_root(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    got = _trie([(c, 0, "u", "gone"), (c, 1, "u", "gone")], spark).collect()  # the base is absent, both turns are replaced
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves) for r in got] == [(c, 0, 1, 1)]


def test_totals_of_odd_forests(spark):
    r = random.Random(3)
    up, level = {}, {}
    for i in range(400):
        shape = r.random()
        up[i] = None if i < 3 else i - 1 if i < 150 else r.randrange(i) if shape < 0.6 else 200 if i > 200 and shape < 0.8 else i - 1
        level[i] = 0 if up[i] is None else level[up[i]] + 1
    rows = [(i, p, level[i], i % 7, 1 if i % 3 else None, "x") for i, p in up.items()]
    tree = spark.createDataFrame(rows, "id long, parent long, depth long, v long, w long, kids string").repartition(4)
    want = {i: [i % 7, int(i % 3 > 0)] for i in up}
    for i in sorted(up, key=lambda i: -level[i]):
        if up[i] is not None:
            want[up[i]] = [a + b for a, b in zip(want[up[i]], want[i], strict=True)]
    assert {x.id: [x.v, x.w] for x in contraction.subtree_totals(tree, ["v", "w"]).collect()} == want
    assert contraction.subtree_totals(tree.limit(0), ["v"]).collect() == []


def test_prime_arithmetic():
    r = random.Random(2)
    x, y = ([r.randrange(modular.PRIME) for _ in range(500)] for _ in range(2))
    a, b = np.array(x, np.uint64), np.array(y, np.uint64)
    assert modular.times(a, b).tolist() == [p * q % modular.PRIME for p, q in zip(x, y, strict=True)]
    assert modular.minus(a, b).tolist() == [(p - q) % modular.PRIME for p, q in zip(x, y, strict=True)]
    assert modular.running(a).tolist() == [sum(x[:i]) % modular.PRIME for i in range(501)]
    e = np.array([0, 1, -1, 77, -78, 10**6])
    assert modular.power(12345, e).tolist() == [pow(12345, int(k), modular.PRIME) for k in e]


def test_sequences_that_agree_modulo_powers_of_two_stay_apart(spark):
    """Thue-Morse sequences of two turns and their complements have one polynomial hash modulo 2**64, whatever the base."""
    bits = [i.bit_count() % 2 for i in range(2048)]
    rows = [(c, i, "u", "ab"[b ^ c % 2]) for c in (21, 22) for i, b in enumerate(bits)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(df).where("depth = 2048").count() == 2


def _family(r, say, n):
    words = say(n)
    out = [" ".join(words), "\n".join(words).upper()]
    for copy in range(1, 5):
        changed = list(words)
        for _ in range(copy * n // 200):
            changed[r.randrange(n)] = say(1)[0]
        out.append(" ".join(changed))
    return [*out, " ".join(words + say(n // 9)), " ".join(words[: n // 2] + say(n // 30) + words[n // 2 + n // 30 :])]


def test_minhash_groups_equal_all_pairs(spark):
    r = random.Random(9)
    say = lambda n: ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n)]
    texts = dict(enumerate(t for _ in range(25) for t in _family(r, say, r.randint(60, 300))))
    passage = " ".join(say(60))
    texts |= {800 + i: f"{passage} {' '.join(say(r.randint(20, 90)))}" for i in range(60)}  # share much, but not enough
    texts |= {900: None, 901: "", 902: "  ", 903: "two words", 904: "Two  words", 905: "other words", 906: "a b c d e f g", 907: "a b c d e f g h", NO_ID: "nameless " * 9}
    rows = [(None if d == NO_ID else d, t, 1, "b", 2) for d, t in texts.items()]
    docs = spark.createDataFrame([*rows, *rows[:9]], "doc_id long, text string, n int, bands string, head int").repartition(3)
    got = {NO_ID if x.doc_id is None else x.doc_id: (x.n_shingles, NO_ID if x.component_id is None else x.component_id) for x in minhash.near_duplicates(docs).collect()}
    want = brute.linked_sets(texts, 85, 5)
    assert got == want and len({c for _, c in want.values()}) < len(want) - 100
    assert {x.doc_id for x in minhash.near_duplicates(docs).where("kept").collect()} == {None if d == NO_ID else d for d, (_, c) in want.items() if d == c}
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_minhash_large_group_around_one_text(spark):
    r = random.Random(11)
    words = [f"w{r.randrange(10**9)}" for _ in range(200)]
    texts = {970: " ".join(words)}
    for d in range(300):  # each like text 970; most pairs of copies are not
        changed = list(words)
        for i in r.sample(range(200), 3):
            changed[i] = f"x{d}n{i}"
        texts[d] = " ".join(changed)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()}
    assert got == brute.linked_sets(texts, 85, 5) and {c for _, c in got.values()} == {0}


def test_sketches_estimate_similarity_and_fill_every_bin():
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 40, 3000):
        both, a, b = (np.unique(r.integers(0, 2**63, size, dtype=np.uint64)) for size in (n, n // 3, n // 3))
        x, y = (minhash.sketch(np.unique(np.concatenate([both, own])), 300) for own in (a, b))
        assert (x < np.uint64(600 << 48)).all() and (x == minhash.sketch(np.concatenate([a, both])[::-1].copy(), 300)).all()
        assert abs((x == y).mean() - n / (n + len(a) + len(b))) < 0.12
    one = minhash.sketch(np.array([5], np.uint64), 300)
    assert len(np.unique(one)) == 300


def test_words_with_one_polynomial_hash_are_different_shingles():
    known = minhash.WordHashes()
    a = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    assert len(minhash.shingle_set(f"{a} {b}".encode(), 1, known)) == 2


@pytest.mark.parametrize(("sample", "cell"), [(20_000, 4000), (400, 20)])
def test_spelling_matches_all_pairs(spark, sample, cell):
    r = random.Random(6)
    syllables = ["ba", "ne", "ti", "ro", "lé", "ß", "st", "ou"]
    vocabulary = ["".join(r.choices(syllables, k=r.randint(2, 5))) for _ in range(250)] + ["ÀÉÎÕÜ÷×", "aaaaaa", "aaaaaaa", "listen", "silent", "sicent", "l" * 700, "l" * 699 + "m"]
    texts = {}
    for d in range(200):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 4)):  # misspelled, often alike
            w = r.choice(vocabulary[:40])
            at = len(w) // 2
            words += [r.choice([w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "y" + w[at + 1 :]])] * r.randint(1, 5)
        texts[d] = r.choice([" ", "1", "\n", "_"]).join(w.upper() if r.random() < 0.1 else w for w in words)
    texts |= {500: None, 501: "", 502: "😀", 503: "word " * 3000}
    rows = [(d, t, "w", 3, "c") for d, t in texts.items()]
    docs = spark.createDataFrame([*rows, *rows[:20]], "doc_id long, text string, word string, n int, cell string").repartition(3)
    got = {x[0]: tuple(x)[1:] for x in spelling.spelling_groups(docs, every=199, sample=sample, cell=cell).collect()}
    want = brute.spelling_groups(texts)
    assert got == want and sum(v[0] is not None for v in want.values()) > 10
    assert spelling.spelling_groups(docs.limit(0)).collect() == []


def test_forms_are_followed_to_the_last(spark):
    rows = [(0, " ".join(["planet"] * 200 + ["planets"] * 30 + ["planetsy"] * 5))]
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {"planet": (None, "planet", 200, 1, None), "planets": ("planet", "planet", 30, 2, 200), "planetsy": ("planets", "planet", 5, 1, 30)}


def test_one_edit():
    row = lambda w: np.array([[ord(c) for c in w]], np.uint32)
    for a, b, near in [("abc", "abd", True), ("abc", "abc", False), ("abc", "acb", False), ("abc", "abbc", True), ("abc", "xabc", True), ("abc", "abcd", True), ("abc", "axby", False)]:
        assert spelling.one_edit(row(a), row(b)).tolist() == [near]
