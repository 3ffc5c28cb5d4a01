"""Queries of the text operators over the driver tables, and their checks in SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import html, leaks, lengths, minhash, quality, repair, secrets, sentences, simhash, spelling, substring, suffix, trie


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_main_text(spark, sf_dir):
    return html.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_repeated_words(spark, sf_dir):
    out = substring.remove_repeats(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_shared_bytes(spark, sf_dir):
    out = suffix.remove_shared(_documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_output(spark, sf_dir):
    return repair.token_output(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_benchmark_leaks(spark, sf_dir):
    return leaks.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_simhash(spark, sf_dir):
    out = simhash.near_duplicates(_documents(spark, sf_dir))
    return out.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op7_secrets(spark, sf_dir):
    return secrets.digests(secrets.find_secrets(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op8_sentence_pieces(spark, sf_dir):
    return sentences.digests(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_token_lengths(spark, sf_dir):
    return lengths.length_histogram(lengths.token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def op10_quality(spark, sf_dir):
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return quality.quality(_documents(spark, sf_dir)).select(columns)


def op11_prefix_trie(spark, sf_dir):
    conv = F.col("conv_id")
    found = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return trie.prefix_trie(found, conv - F.pmod(conv, F.lit(20)), F.crc32(conv.cast("string").cast("binary")) % 4)


def op12_minhash(spark, sf_dir):
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op13_spelling(spark, sf_dir):
    return spelling.spelling_groups(_documents(spark, sf_dir), every=199)


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)"""


def _covered(name: str, width: int) -> str:
    return f"""{name}_win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {width - 1}], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM d WHERE len(w) >= {width})),
{name}_two AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM {name}_win) WHERE c > 1),
{name} AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {width})) AS p FROM {name}_two) GROUP BY doc_id)"""


OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
{_covered("short", 8)},
{_covered("mid", 20)},
{_covered("long", 101)},
f AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
  coalesce(short.n, 0)::BIGINT AS n_repeat_words, coalesce(mid.n, 0) AS m, coalesce(long.n, 0) AS x
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN short USING (doc_id) LEFT JOIN mid USING (doc_id) LEFT JOIN long USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * m <= 20 * n_words AND x = 0 AS kept FROM b"""

OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
near AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, near.b FROM reach JOIN near ON near.a = reach.other),
least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least_of LEFT JOIN size USING (doc_id)"""

QUERIES = {f.__name__: f for f in (op1_main_text, op2_repeated_words, op3_shared_bytes, op4_token_output, op5_benchmark_leaks, op6_simhash, op7_secrets, op8_sentence_pieces, op9_token_lengths, op10_quality, op11_prefix_trie, op12_minhash, op13_spelling)}
CHECKS = {"op2_repeated_words": OP2_SQL, "op10_quality": OP10_SQL, "op12_minhash": OP12_SQL}
