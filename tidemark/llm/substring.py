"""Long repeated word strings, by a de Bruijn graph whose paths are compacted.

The edges are the windows of `width` consecutive words that occur more than once. Every occurrence is joined with the
first occurrence of its edge (the source). Where the next occurrence in a text follows the next one of the same source,
the graph does not branch: such a path becomes one span with one source span. Each span is then compared with its source
by a digest over the words at both coordinates.

Minimizers leave out windows that cannot repeat before any edge is built (`anchors`). Edges are told apart by 96 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.anchors import address_schema, addressed, delivered, flagged, packed, possible_repeats, runs_of
from tidemark.llm.common import U, blocks, joined, keyed, partitions, plain_id, stored, window_hashes

MINIMIZER_SHARE = 2  # a minimizer has half as many words as a window


def repeated_spans(docs: DataFrame, width: int = 20) -> DataFrame:
    """Compacted paths: doc_id, start, n_words, source_doc, source_start (word places), as rows, for keyed documents.

    A span covers windows whose words also start earlier, in a smaller doc_id or earlier in the same text; the source is
    the first place in the order of doc_id and place.
    """
    parts, k = partitions(docs.sparkSession), max(1, width // MINIMIZER_SHARE)
    marks = possible_repeats(docs, True, width, k, parts, across=False)

    def edges(batches):
        for batch in batches:
            found = []
            base = 0
            for block in blocks([batch]):
                runs = runs_of(block.column("text"), True, width, k, twice=True)
                keep = np.repeat(flagged(runs, block, parts), runs.lengths)
                places = runs.places[keep]
                counts = np.maximum(np.diff(runs.firsts) - width + 1, 0)
                owner = np.repeat(np.arange(len(counts)), counts)[keep]
                low = window_hashes(runs.symbols, width)[places]
                high = (window_hashes(runs.others, width)[places] >> U(32)).astype(np.uint32)
                found.append((owner + base, (places - runs.firsts[owner]).astype(np.uint32), low, high))
                base += block.num_rows
            if base:
                owner, place, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
                columns = packed(batch.column("doc_id").to_numpy(), owner, (low % U(parts)).astype(np.int64), [place, low, high], parts)
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "ids", "counts", "places", "low", "high"])

    def sources(table: pa.Table) -> pa.Table:
        docs_of = np.repeat(joined(table["ids"], np.int64), joined(table["counts"], np.uint32))
        place, low, high = joined(table["places"], np.uint32), joined(table["low"], np.uint64), joined(table["high"], np.uint32)
        order = np.lexsort((place, docs_of, high, low))
        docs_of, place, low, high = docs_of[order], place[order], low[order], high[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        source = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = np.flatnonzero(~new)
        names = ["places", "source_docs", "source_places"]
        return addressed(docs_of[later], [place[later], docs_of[source[later]], place[source[later]]], names, parts)

    def paths(batches):
        for batch in batches:
            rows = [[], [], [], [], []]
            for i in range(batch.num_rows):
                place, doc, at = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("places", np.uint32), ("source_docs", np.int64), ("source_places", np.uint32)))
                order = np.argsort(place)
                place, doc, at = place[order].astype(np.int64), doc[order], at[order].astype(np.int64)
                new = np.ones(len(place), bool)
                new[1:] = (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
                first = np.flatnonzero(new)
                length = np.diff(np.append(first, len(place)))
                for to, x in zip(rows, (np.full(len(first), batch.column("doc_id")[i].as_py()), place[first], length + width - 1, doc[first], at[first]), strict=True):
                    to.append(x)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in rows], ["doc_id", "start", "n_words", "source_doc", "source_start"])

    sent = docs.join(marks, "doc_id").select("doc_id", "text", "buckets", "flags").mapInArrow(edges, "bucket int, ids binary, counts binary, places binary, low binary, high binary")
    back = sent.groupBy("bucket").applyInArrow(sources, address_schema(["places", "source_docs", "source_places"]))
    lists = delivered(back, {"places": np.uint32, "source_docs": np.int64, "source_places": np.uint32})
    return lists.mapInArrow(paths, "doc_id long, start long, n_words long, source_doc long, source_start long")


def _digest(words: list[bytes], start: int, n: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start : start + n]), digest_size=16).digest()


def remove_repeats(documents: DataFrame, width: int = 20) -> DataFrame:
    """Documents without words that an earlier place of the corpus has already, in windows of `width` words.

    Returns doc_id, n_words, n_removed, kept (the remaining words, joined by one space) and spans (start and length of
    each verified path). Null and empty texts have no words; repeated rows of one id fold into one (`keyed`); texts
    shorter than a window keep everything; an empty table gives an empty result.
    """
    docs = keyed(documents)
    spans = stored(repeated_spans(docs, width))
    asked = spans.groupBy("source_doc", "source_start", "n_words").agg(F.lit(1).alias("_"))
    asked = asked.groupBy(F.col("source_doc").alias("doc_id")).agg(F.collect_list(F.struct("source_start", "n_words")).alias("asked"))

    def digests(batches):
        for batch in batches:
            rows = []
            for doc, text, asked_here in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("asked").to_pylist(), strict=True):
                words = text.as_py().split()
                rows += [(doc, x["source_start"], x["n_words"], _digest(words, x["source_start"], x["n_words"])) for x in asked_here]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["source_doc", "source_start", "n_words", "digest"])

    told = docs.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(digests, "source_doc long, source_start long, n_words long, digest binary")
    checked = spans.join(told, ["source_doc", "source_start", "n_words"]).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n_words", "digest")).alias("spans"))

    def without(batches):
        for batch in batches:
            rows = []
            for text, found in zip(batch.column("text").cast(pa.binary()), batch.column("spans").to_pylist(), strict=True):
                words = text.as_py().split()
                found = sorted(((x["start"], x["n_words"], x["digest"]) for x in found or ()), key=lambda x: x[:2])
                gone = np.zeros(len(words), bool)
                for start, n, digest in found:
                    if _digest(words, start, n) != digest:
                        raise ValueError("a span differs from its source: two edges share one fingerprint")
                    gone[start : start + n] = True
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if found else words
                rows.append((len(words), len(words) - len(kept), b" ".join(kept), [(s, n) for s, n, _ in found]))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())])))
            spans_col = pa.array([[{"start": s, "n_words": n} for s, n in x] for x in columns[3]], kinds[3])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns[:2], kinds, strict=False)), pa.array(columns[2], pa.binary()).cast(pa.string()), spans_col], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    whole = docs.join(checked, "doc_id", "left").select("doc_id", "text", "spans")
    out = whole.mapInArrow(without, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,n_words:long>>")
    return out.select(plain_id(), "n_words", "n_removed", "kept", "spans")
