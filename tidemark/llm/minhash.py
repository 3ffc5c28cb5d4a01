"""Near duplicates by MinHash: fast similarity sketches, bands of their coordinates, exact comparison of shingle sets.

A sketch has t bins. In round i each shingle is thrown into a hashed bin and leaves (i, hash) there if that is less than
what the bin holds; in rounds t to 2t - 1 all shingles go to bin i - t, so every bin is filled whatever the set. A set of n
shingles needs about t log(t) / n rounds. Two bins hold the same with the Jaccard similarity of the sets, and the number
that do is concentrated as with t independent hashes.

Texts whose bands agree share a bucket. Only repeated buckets go on, equal sets are one text throughout, and a bucket
compares a few heads with the texts of other groups per round, until it holds texts of one group only. The first head is
the text with most others around it. Whether an odd number of a text's shingles falls into each of some hashed cells bounds
what two texts can share, so the outer copies of a family, which are far from each other, are told apart without their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import pick_bounded
from tidemark.llm.common import NO_ID, blocks, keyed, mixed, partitions, plain_id, stored
from tidemark.llm.simhash import components
from tidemark.session import scratch_folder

BANDS, ROWS = 50, 6  # a link at 0.85 shares no band with a probability of (1 - 0.85**6)**50 = 5e-11
PARITY = 16  # 64-bit words of cells whose count is odd or even
FIRST_HEADS = 256
PAIRS_AT_ONCE = 512  # comparisons with one head that one task does at least; more are dealt out

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """XXH64 of words, kept for the words to come."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 42)
        return found


def shingle_set(text: bytes, words: int, known: WordHashes) -> np.ndarray:
    """Hashes of the distinct shingles of one text, ascending. Fewer words are one shingle, no word gives none."""
    found = text.lower().split()
    h = np.fromiter(map(known.__getitem__, found), U, len(found))
    if not len(h):
        return h
    width = min(words, len(h))
    n = len(h) - width + 1
    out = mixed(h[:n] + U(width))
    for k in range(1, width):
        out = mixed(out * _STEP + h[k : k + n])
    return np.unique(out)


def sketch(hashes: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch of a set: per bin the least (round, hash), the round in the upper 16 bits."""
    out = np.full(bins, ~U(0))
    done = 0
    while done < bins:  # so many rounds at once that they are likely to fill what is empty
        rounds = np.arange(done, min(bins, done + max(1, 4 * bins // len(hashes))), dtype=U)[:, None]
        thrown = mixed(hashes[None, :] ^ mixed(rounds + _STEP)).ravel()
        value = (thrown >> U(16)) | np.repeat(rounds[:, 0] << U(48), len(hashes))
        np.minimum.at(out, (thrown % U(bins)).astype(np.int64), value)
        done += len(rounds)
        if (out != ~U(0)).all():
            return out
    for b in np.flatnonzero(out == ~U(0)).tolist():
        i = np.array([bins + b], U)
        out[b] = ((mixed(hashes ^ mixed(i + _STEP)) >> U(16)) | (i << U(48))).min()
    return out


def bands_of(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, different in each band."""
    cells = sketch(hashes, bands * rows).reshape(bands, rows)
    out = mixed(np.arange(bands, dtype=U) + _STEP)
    for k in range(rows):
        out = mixed(out * _STEP + cells[:, k])
    return out


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n (size of the set), same (digest of the set), bands and parity of keyed documents; no bands without shingles.

    parity: for each of 64 * `PARITY` hashed cells whether an odd number of shingles falls into it.
    """

    def made(batches):
        known = WordHashes()
        for block in blocks(batches):
            sets = [shingle_set(t.as_py(), words, known) for t in block.column("text").cast(pa.binary())]
            same = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            keys = [bands_of(x, bands, rows).view(np.int64) if len(x) else [] for x in sets]
            odd = [np.packbits(np.bincount((x % U(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1).view(np.int64) for x in sets]
            columns = [pa.array([len(x) for x in sets], pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *columns], ["doc_id", "n", "same", "bands", "parity"])

    return docs.mapInArrow(made, "doc_id long, n long, same binary, bands array<long>, parity array<long>")


def compare(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (head, doc) with 100 * common shingles >= percent * all shingles, counted on the whole sets.

    Texts go to the head's piece of pairs; a task reads the head first and then text by text, so it holds two sets.
    """
    parts = partitions(pairs.sparkSession)
    pieces = pairs.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / PAIRS_AT_ONCE).alias("pieces"))
    dealt = stored(pairs.join(pieces, "head").select("head", "doc", F.pmod(F.xxhash64("doc"), "pieces").alias("piece")))
    members = dealt.join(texts.withColumnRenamed("doc_id", "doc"), "doc").select("head", "piece", F.lit(1).alias("kind"), "doc", "text")
    heads = dealt.select("head", "piece").distinct().join(texts.withColumnRenamed("doc_id", "head"), "head").select("head", "piece", F.lit(0).alias("kind"), F.col("head").alias("doc"), "text")

    def linked(batches):
        known, own = WordHashes(), None
        for batch in batches:
            for block in blocks([batch]):
                found = []
                for head, kind, doc, text in zip(*(block.column(c) for c in ("head", "kind", "doc")), block.column("text").cast(pa.binary()), strict=True):
                    other = shingle_set(text.as_py(), words, known)
                    if kind.as_py() == 0:
                        own = other
                        continue
                    both = np.concatenate([own, other])
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    if 100 * common >= percent * (len(both) - common):
                        found.append((head.as_py(), doc.as_py()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    rows = members.unionByName(heads).repartition(parts, "head", "piece").sortWithinPartitions("head", "piece", "kind")
    return rows.mapInArrow(linked, "a long, b long")


def _within_reach(percent: int):
    """Whether two sets can be linked by their sizes and parities: a cell of other parity holds a shingle of one set only."""
    n, m = F.col("n"), F.col("head_n")
    apart = sum((F.bit_count(F.get("parity", F.lit(i)).bitwiseXOR(F.get("head_parity", F.lit(i)))) for i in range(PARITY)), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * apart <= (100 - percent) * (n + m))


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Group of near copies of each document: doc_id, n_shingles (size of its set), component_id (smallest doc_id
    reachable), kept (whether it is that document).

    Links hold between documents whose sets of `words`-word shingles have `percent` % of their union in common. Words are
    what lies between ASCII white space, A-Z lower-cased; fewer words are one shingle, and a text without words (null and
    empty too) has none and links with nothing. Repeated rows fold into one (`keyed`); a null doc_id is a document of its
    own (component_id null, kept); an empty table gives an empty result. Other columns are ignored.

    Candidates share a band (see `BANDS` for what that can miss) and each is compared exactly. All pairs of a bucket are
    covered but for those whose texts other links have already put into one group.
    """
    docs = keyed(documents)
    prints = stored(sketches(docs, words, bands, rows))
    firsts = prints.where("n > 0").groupBy("same").agg(F.min("doc_id").alias("doc_id"))
    each = prints.join(firsts.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("s"))
    repeated = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    posts = stored(each.join(repeated, "s"))

    # texts without a repeated bucket are alone; the others are written once for all rounds
    folder = f"{scratch_folder(documents.sparkSession)}/texts"
    docs.join(posts.select("doc_id").distinct(), "doc_id", "left_semi").write.parquet(folder)
    texts = documents.sparkSession.read.parquet(folder)
    facts = prints.select("doc_id", "n", "parity")
    of_head = facts.toDF("head", "head_n", "head_parity")

    def linked_among(met: DataFrame) -> DataFrame:
        """Links among pairs (head, doc_id) that have met in any number of buckets, in either order."""
        pairs = met.groupBy(F.least("head", "doc_id").alias("a"), F.greatest("head", "doc_id").alias("b")).agg(F.min("head").alias("head"))
        pairs = stored(pairs.select("head", F.when(F.col("head") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("doc")))
        return stored(compare(pairs, texts, words, percent))

    # first the text of each bucket that has most others around it: in a family of copies that is their source
    weight = posts.groupBy("doc_id").agg(F.sum("df").alias("weight"))
    hubs = posts.join(weight, "doc_id").groupBy("s").agg(F.max(F.struct("weight", "doc_id"))["doc_id"].alias("head"))
    met = posts.join(hubs, "s").where("doc_id <> head").select("head", "doc_id").distinct()
    linked = linked_among(met.join(of_head, "head").join(facts, "doc_id").where(_within_reach(percent)))
    posts = posts.where("df > 2").join(hubs.select("s", F.col("head").alias("doc_id")), ["s", "doc_id"], "left_anti").select("s", "doc_id")
    heads_each, roots = FIRST_HEADS, None
    while True:
        if roots is None:
            roots = stored(components(linked).withColumnRenamed("node", "doc_id"))
        named = posts.select("s", "doc_id").join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        open_ = named.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("s")
        posts = stored(named.join(open_, "s"))
        if posts.isEmpty():
            break
        # texts of the smallest groups first: they have the most to be compared with
        group_sizes = posts.groupBy("s", "root").agg(F.count(F.lit(1)).alias("size"))
        ranked = pick_bounded(posts.join(group_sizes, ["s", "root"]), ["s"], [F.asc("size"), F.asc(F.xxhash64("doc_id")), F.asc("doc_id")], heads_each)
        heads = stored(ranked.select("s", F.col("doc_id").alias("head"), F.col("root").alias("own")))
        met = posts.join(facts, "doc_id").join(heads.join(of_head, "head"), "s").where((F.col("root") != F.col("own")) & _within_reach(percent))
        new = linked_among(met)
        if not new.isEmpty():
            linked, roots = linked.union(new), None
        posts = posts.join(heads.select("s", F.col("head").alias("doc_id")), ["s", "doc_id"], "left_anti")
        heads_each *= FIRST_HEADS
    named = firsts.join(roots, "doc_id", "left").select("same", F.coalesce("root", "doc_id").alias("component"))
    out = prints.join(named, "same", "left").withColumn("component", F.coalesce("component", "doc_id"))
    return out.select(plain_id(), F.col("n").alias("n_shingles"), F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"), (F.col("component") == F.col("doc_id")).alias("kept"))
