"""Review and document-corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import reviews as R
from tidemark.plans.registry import query


def review_texts(t):
    """Documents with a review header in front, its figures taken from the document."""
    k, n = F.col("doc_id"), F.col("n_chars")
    s = lambda c: c.cast("string")
    issues = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(i <= n % 5, F.concat(s(i), F.lit(". issue\n"))).otherwise("")), "")
    text = F.concat(
        F.when(k % 9 == 4, "").otherwise(F.concat(F.lit("**Overall:** "), s(F.lit(40) + n % 61), F.lit("/100\n"))),
        F.when(k % 10 == 7, "").otherwise(F.concat(F.lit("### Agent Executability Verdict\n**"), F.when(n % 2 == 0, "EXECUTABLE").otherwise("NEEDS_REFINEMENT"), F.lit("**\n"))),
        F.lit("| Dimension | Score | Weight |\n| Actionability | "), s(n % 26), F.lit("/25 | 25% |\n| Completeness | "), s(k % 26), F.lit("/25 | 25% |\n| Consistency | "),
        s(n % 16), F.lit("/15 | 15% |\n"), F.when(k % 3 > 0, F.concat(F.lit("| Token Efficiency | "), s(k % 11), F.lit("/10 | 10% |\n"))).otherwise(""),
        F.lit("### Critical Issues\n"), issues,
        F.lit("### Timing\n"),
        F.when(k % 4 == 0, "").otherwise(
            F.concat(F.lit("| Run ID | `"), F.substring(F.md5(s(k)), 1, 16), F.lit("` |\n| Model | m |\n| Duration | "), s(n % 9), F.lit("m "), s(n % 60), F.lit("s ("), s(n % 900), F.lit(".25s) |\n"))
        ),
        F.col("text"),
    )
    return t.table("documents").select("doc_id", text.alias("text"))


_TEXTS = """rt AS (SELECT doc_id, CASE WHEN doc_id % 9 = 4 THEN '' ELSE '**Overall:** ' || (40 + n_chars % 61) || '/100' || chr(10) END
  || CASE WHEN doc_id % 10 = 7 THEN '' ELSE '### Agent Executability Verdict' || chr(10) || '**' || CASE WHEN n_chars % 2 = 0 THEN 'EXECUTABLE' ELSE 'NEEDS_REFINEMENT' END || '**' || chr(10) END
  || '| Dimension | Score | Weight |' || chr(10) || '| Actionability | ' || (n_chars % 26) || '/25 | 25% |' || chr(10) || '| Completeness | ' || (doc_id % 26) || '/25 | 25% |' || chr(10)
  || '| Consistency | ' || (n_chars % 16) || '/15 | 15% |' || chr(10) || CASE WHEN doc_id % 3 > 0 THEN '| Token Efficiency | ' || (doc_id % 11) || '/10 | 10% |' || chr(10) ELSE '' END
  || '### Critical Issues' || chr(10) || coalesce((SELECT string_agg(i || '. issue' || chr(10), '' ORDER BY i) FROM range(1, 5) r(i) WHERE i <= n_chars % 5), '') || '### Timing' || chr(10)
  || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '| Run ID | `' || left(md5(CAST(doc_id AS VARCHAR)), 16) || '` |' || chr(10) || '| Model | m |' || chr(10) || '| Duration | ' || (n_chars % 9) || 'm ' || (n_chars % 60) || 's (' || (n_chars % 900) || '.25s) |' || chr(10) END
  || text AS text FROM documents)"""


def _num(pattern: str) -> str:
    return f"CAST(nullif(regexp_extract(text, '{pattern}', 1), '') AS BIGINT)"


_META = f"""{_TEXTS}, meta AS (SELECT doc_id, {_num("\\*\\*Overall:\\*\\* (\\d+)/100")} AS overall_score,
  coalesce(nullif(regexp_extract(text, '### Agent Executability Verdict\\s+\\*\\*([A-Z_]+)\\*\\*', 1), ''), 'UNKNOWN') AS verdict,
  len(regexp_extract_all(string_split(regexp_extract(text, '(?s)### Critical Issues\\s+(.*)', 1), '###')[1], '(?m)^\\d+\\.')) AS critical_issues,
  {", ".join(_num(rf"\|\s*{label}\s*\|\s*(\d+)/{top}") + " AS " + name for name, (label, top) in R.REVIEW_DIMENSIONS.items())} FROM rt)"""


def meta(t):
    return R.extract_review_metadata(review_texts(t))


@query("extract_review_metadata", f"WITH {_META} SELECT * FROM meta")
def _(t):
    return meta(t)


_BLOCK = "(?s)\\|\\s*Run ID\\s*\\|\\s*`([a-f0-9]+)`\\s*\\|.*?\\|\\s*Duration\\s*\\|\\s*(\\d+m \\d+s)\\s*\\((\\d+\\.?\\d*)s\\)\\s*\\|"
_BLOCKS = f"""{_TEXTS}, blocks AS (SELECT doc_id, regexp_extract(text, '{_BLOCK}', 1) AS run_id, regexp_extract(text, '{_BLOCK}', 2) AS duration_human,
  CAST(nullif(regexp_extract(text, '{_BLOCK}', 3), '') AS DOUBLE) AS duration_seconds FROM rt)"""


@query("extract_timing_blocks", f"WITH {_BLOCKS} SELECT * FROM blocks WHERE run_id <> ''")
def _(t):
    return R.extract_timing_blocks(review_texts(t))


@query(
    "timing_block_totals",
    f"""WITH {_BLOCKS} SELECT count(*) AS run_count, round(CAST(sum(CAST(duration_seconds AS DECIMAL(20,4))) AS DOUBLE), 2) AS total_seconds,
        round(CAST(sum(CAST(duration_seconds AS DECIMAL(20,4))) AS DOUBLE) / count(*), 2) AS avg_seconds FROM blocks WHERE run_id <> ''""",
)
def _(t):
    return R.timing_block_totals(R.extract_timing_blocks(review_texts(t)))


def _scores(t, weights):
    """Raw dimension scores of documents, from 0 to 10."""
    n = F.col("n_chars")
    return t.table("documents").select(
        "doc_id", *[((n * (i + 3) + F.col("doc_id")) % 11).alias(w) for i, w in enumerate(weights)], (n % 27).alias("blocking_issues")
    )


def _points_sql(weights) -> str:
    raw = ", ".join(f"(n_chars * {i + 3} + doc_id) % 11 AS {w}" for i, w in enumerate(weights))
    total = " + ".join(f"{w} * {v / 2}" for w, v in weights.items())
    return f"raw AS (SELECT doc_id, {raw}, n_chars % 27 AS blocking_issues FROM documents), sc AS (SELECT *, CAST({total} AS DOUBLE) AS total_points FROM raw)"


@query("weighted_score", f"WITH {_points_sql(R.RULE_WEIGHTS)} SELECT doc_id, round(total_points, 1) AS total_points FROM sc")
def _(t):
    return R.weighted_score(_scores(t, R.RULE_WEIGHTS), R.RULE_WEIGHTS).select("doc_id", "total_points")


@query(
    "rule_verdict",
    f"""WITH {_points_sql(R.RULE_WEIGHTS)} SELECT doc_id, CASE WHEN actionability <= 4 AND completeness <= 4 THEN 'NOT_EXECUTABLE' WHEN total_points >= 103 THEN 'EXECUTABLE'
        WHEN total_points >= 92 THEN 'EXECUTABLE_WITH_REFINEMENTS' WHEN total_points >= 70 THEN 'NEEDS_REFINEMENT' ELSE 'NOT_EXECUTABLE' END AS verdict FROM sc""",
)
def _(t):
    return R.verdict(R.weighted_score(_scores(t, R.RULE_WEIGHTS), R.RULE_WEIGHTS), "rule").select("doc_id", "verdict")


def _band_sql(names: list[str], weak: str, cap: str) -> str:
    return f"""x AS (SELECT doc_id, {cap} AS capped_points, {weak} AS weak FROM sc),
      y AS (SELECT *, greatest(CASE WHEN capped_points >= 90 THEN 0 WHEN capped_points >= 80 THEN 1 WHEN capped_points >= 60 THEN 2 WHEN capped_points >= 40 THEN 3 ELSE 4 END,
        CASE WHEN weak >= 2 THEN 3 WHEN weak = 1 THEN 2 ELSE 0 END) AS lv FROM x)
      SELECT doc_id, capped_points, {names}[lv + 1] AS verdict FROM y"""


@query(
    "plan_verdict",
    f"WITH {_points_sql(R.PLAN_WEIGHTS)}, "
    + _band_sql(
        ["EXCELLENT_PLAN", "GOOD_PLAN", "NEEDS_WORK", "POOR_PLAN", "INADEQUATE_PLAN"],
        "(executability <= 4)::INT + (completeness <= 4)::INT + (success_criteria <= 4)::INT + (scope <= 4)::INT",
        "CASE WHEN blocking_issues >= 20 THEN least(total_points, 40.0) WHEN blocking_issues >= 10 THEN least(total_points, 60.0) ELSE total_points END",
    ),
)
def _(t):
    return R.verdict(R.weighted_score(_scores(t, R.PLAN_WEIGHTS), R.PLAN_WEIGHTS), "plan").select("doc_id", "capped_points", "verdict")


@query(
    "doc_verdict",
    f"WITH {_points_sql(R.DOC_WEIGHTS)}, "
    + _band_sql(["EXCELLENT", "GOOD", "NEEDS_IMPROVEMENT", "POOR", "INADEQUATE"], "(accuracy <= 4)::INT + (completeness <= 4)::INT", "total_points"),
)
def _(t):
    return R.verdict(R.weighted_score(_scores(t, R.DOC_WEIGHTS), R.DOC_WEIGHTS), "doc").select("doc_id", "capped_points", "verdict")


@query(
    "bulk_stats",
    f"""WITH {_META}, o AS (SELECT *, row_number() OVER (ORDER BY overall_score) - 1 AS rn, count(*) OVER () AS n FROM meta WHERE overall_score IS NOT NULL)
    SELECT (SELECT count(*) FROM meta) AS total_reviewed, count(*) AS successful, (SELECT count(*) FROM meta WHERE overall_score IS NULL) AS failed,
      round(CAST(sum(overall_score) AS DOUBLE) / count(*), 1) AS average_score, count(*) FILTER (overall_score >= 90) AS excellent,
      count(*) FILTER (overall_score BETWEEN 80 AND 89) AS good, count(*) FILTER (overall_score BETWEEN 60 AND 79) AS needs_work, count(*) FILTER (overall_score < 60) AS poor,
      max(overall_score) FILTER (rn = n // 2) AS median_score FROM o""",
)
def _(t):
    return R.bulk_stats(meta(t))


@query("verdict_counts", f"WITH {_META} SELECT verdict, count(*) AS review_count FROM meta WHERE overall_score IS NOT NULL GROUP BY 1")
def _(t):
    return R.verdict_counts(meta(t))


@query(
    "dimension_means",
    f"WITH {_META}, u AS (" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {top} AS mx, {d} AS p FROM meta WHERE overall_score IS NOT NULL" for d, (_, top) in R.REVIEW_DIMENSIONS.items())
    + "), a AS (SELECT dimension, round(CAST(sum(p) AS DOUBLE) / count(p), 1) AS average, CAST(max(mx) AS BIGINT) AS max_points FROM u WHERE p IS NOT NULL GROUP BY 1) "
    "SELECT *, round(average / max_points * 100, 1) AS percentage FROM a",
)
def _(t):
    return R.dimension_means(meta(t))


@query(
    "critical_bands",
    f"""WITH {_META} SELECT CASE WHEN critical_issues = 0 THEN '0' WHEN critical_issues <= 2 THEN '1-2' ELSE '3+' END AS band, count(*) AS review_count,
        round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM meta WHERE overall_score IS NOT NULL), 1) AS share_pct FROM meta WHERE overall_score IS NOT NULL GROUP BY 1""",
)
def _(t):
    return R.critical_bands(meta(t))


@query(
    "priority_tiers",
    f"""WITH {_META}, x AS (SELECT doc_id, overall_score, CAST(CASE WHEN overall_score < 60 THEN 1 WHEN overall_score < 80 THEN 2 WHEN overall_score < 90 THEN 3 ELSE 4 END AS BIGINT) AS tier
        FROM meta WHERE overall_score IS NOT NULL)
    SELECT *, row_number() OVER (PARTITION BY tier ORDER BY CASE WHEN tier = 4 THEN -overall_score ELSE overall_score END, md5(CAST(doc_id AS VARCHAR))) AS position FROM x""",
)
def _(t):
    return R.priority_tiers(meta(t))


@query(
    "top_improvements",
    """WITH i AS (SELECT doc_id AS item_id, n_chars % 50 AS impact, doc_id % 9 AS effort FROM documents)
    SELECT *, round(impact / CAST(nullif(effort, 0) AS DOUBLE), 4) AS ratio FROM i ORDER BY ratio DESC NULLS LAST, impact DESC, item_id LIMIT 10""",
)
def _(t):
    items = t.table("documents").select(F.col("doc_id").alias("item_id"), (F.col("n_chars") % 50).alias("impact"), (F.col("doc_id") % 9).alias("effort"))
    return R.top_improvements(items)


def issues(t, which: str):
    """Issues of plans: one per event; the two versions renumber some and drop others."""
    e, u = F.col("event_id"), F.col("user_id")
    df = t.table("events")
    plan, text = u.alias("plan_id"), F.concat_ws(" ", F.lit("issue"), (e % 97).cast("string"), F.floor(F.col("value")).cast("string")).alias("description")
    line = (e % 500).alias("line")
    if which == "base":
        return df.filter("event_type in ('error', 'click', 'view')").select(plan, e.alias("issue_id"), line, text)
    if which == "middle":
        return df.filter("event_type in ('error', 'view')").select(plan, e.alias("issue_id"), line, text)
    return df.filter("event_type in ('click', 'view', 'signup')").select(plan, F.when(F.col("event_type") == "view", e + 1000000000).otherwise(e).alias("issue_id"), line, text)


_ISSUES = """b AS (SELECT user_id AS plan_id, event_id AS issue_id, event_id % 500 AS ln, 'issue ' || (event_id % 97) || ' ' || CAST(floor(value) AS BIGINT) AS d FROM events WHERE event_type IN ('error', 'click', 'view')),
  mi AS (SELECT user_id AS plan_id, event_id AS issue_id FROM events WHERE event_type IN ('error', 'view')),
  c AS (SELECT user_id AS plan_id, CASE WHEN event_type = 'view' THEN event_id + 1000000000 ELSE event_id END AS issue_id, event_id % 500 AS ln, 'issue ' || (event_id % 97) || ' ' || CAST(floor(value) AS BIGINT) AS d
    FROM events WHERE event_type IN ('click', 'view', 'signup')),
  m0 AS (SELECT b.plan_id, b.issue_id AS bi, c.issue_id AS ci FROM b JOIN c ON b.plan_id = c.plan_id AND b.issue_id = c.issue_id),
  l0 AS (SELECT plan_id, ln, min(issue_id) AS bi FROM b WHERE (plan_id, issue_id) NOT IN (SELECT (plan_id, bi) FROM m0) GROUP BY 1, 2),
  r0 AS (SELECT plan_id, ln, min(issue_id) AS ci FROM c WHERE (plan_id, issue_id) NOT IN (SELECT (plan_id, ci) FROM m0) GROUP BY 1, 2),
  m1 AS (SELECT * FROM m0 UNION ALL SELECT plan_id, bi, ci FROM l0 JOIN r0 USING (plan_id, ln)),
  l AS (SELECT plan_id, d, min(issue_id) AS bi FROM b WHERE (plan_id, issue_id) NOT IN (SELECT (plan_id, bi) FROM m1) GROUP BY 1, 2),
  r AS (SELECT plan_id, d, min(issue_id) AS ci FROM c WHERE (plan_id, issue_id) NOT IN (SELECT (plan_id, ci) FROM m1) GROUP BY 1, 2),
  m AS (SELECT * FROM m1 UNION ALL SELECT plan_id, bi, ci FROM l JOIN r USING (plan_id, d)),
  delta AS (SELECT plan_id, bi AS issue_id, CASE WHEN (plan_id, bi) IN (SELECT (plan_id, issue_id) FROM mi) THEN 'OPEN' ELSE 'REGRESSION' END AS status FROM m
    UNION ALL SELECT plan_id, issue_id, 'FIXED' FROM b WHERE (plan_id, issue_id) NOT IN (SELECT (plan_id, bi) FROM m)
    UNION ALL SELECT plan_id, issue_id, 'NEW' FROM c WHERE (plan_id, issue_id) NOT IN (SELECT (plan_id, ci) FROM m))"""


def _delta(t):
    return R.delta_review(issues(t, "base"), issues(t, "current"), issues(t, "middle"))


@query("delta_review", f"WITH {_ISSUES} SELECT * FROM delta")
def _(t):
    return _delta(t)


@query(
    "delta_summary",
    f"""WITH {_ISSUES}, s AS (SELECT plan_id, count(*) FILTER (status = 'FIXED') AS fixed, count(*) FILTER (status = 'OPEN') AS open, count(*) FILTER (status = 'NEW') AS new,
        count(*) FILTER (status = 'REGRESSION') AS regressions FROM delta GROUP BY 1) SELECT *, fixed - new - regressions AS net_change FROM s""",
)
def _(t):
    return R.delta_summary(_delta(t))


def _points(t, remainder: int):
    """Best points per dimension of the even or odd documents of a plan."""
    m = meta(t).filter(F.col("doc_id") % 2 == remainder)
    names = list(R.REVIEW_DIMENSIONS)
    long = m.select((F.floor(F.col("doc_id") / 2) % 50).alias("plan_id"), *names).unpivot(["plan_id"], names, "dimension", "points")
    return long.filter("points is not null").groupBy("plan_id", "dimension").agg(F.max("points").alias("points"))


@query(
    "dimension_delta",
    f"""WITH {_META}, u AS (""" + " UNION ALL ".join(f"SELECT doc_id % 2 AS side, doc_id // 2 % 50 AS plan_id, '{d}' AS dimension, {d} AS p FROM meta" for d in R.REVIEW_DIMENSIONS)
    + """), a AS (SELECT side, plan_id, dimension, max(p) AS p FROM u WHERE p IS NOT NULL GROUP BY 1, 2, 3),
    d AS (SELECT plan_id, dimension, max(p) FILTER (side = 0) AS baseline, max(p) FILTER (side = 1) AS current FROM a GROUP BY 1, 2),
    x AS (SELECT * FROM d UNION ALL SELECT plan_id, 'TOTAL', CAST(sum(baseline) AS BIGINT), CAST(sum(current) AS BIGINT) FROM d GROUP BY 1)
    SELECT *, current - baseline AS change FROM x""",
)
def _(t):
    return R.dimension_delta(_points(t, 0), _points(t, 1))


@query(
    "review_variance",
    f"""WITH {_META}, p AS (SELECT doc_id % 50 AS plan_id, count(*) AS review_count, round(CAST(sum(overall_score) AS DOUBLE) / count(*), 2) AS mean_score,
        CAST(max(overall_score) - min(overall_score) AS DOUBLE) AS variance FROM meta WHERE overall_score IS NOT NULL GROUP BY 1)
    SELECT *, CASE WHEN variance <= 5 THEN 'CONSISTENT' ELSE 'HIGH_VARIANCE' END AS status, rank() OVER (ORDER BY mean_score DESC) AS plan_rank,
      rank() OVER (ORDER BY mean_score DESC) = 1 AS is_winner FROM p""",
)
def _(t):
    return R.review_variance(meta(t).withColumn("plan_id", F.col("doc_id") % 50))


_LINES = "len(string_split(text, chr(10)))"


@query(
    "size_score",
    f"""WITH x AS (SELECT doc_id, {_LINES} * 12 AS line_count FROM documents)
    SELECT doc_id, line_count, CAST(CASE {" ".join(f"WHEN line_count <= {a} THEN {b}" for a, b, _ in R.SIZE_BANDS)} ELSE 0 END AS BIGINT) AS size_score,
      CASE {" ".join(f"WHEN line_count <= {a} THEN '{c}'" for a, _, c in R.SIZE_BANDS)} ELSE 'NOT_DEPLOYABLE' END AS flag,
      round((line_count - 500) * 100.0::DOUBLE / 500, 1) AS variance_pct FROM x""",
)
def _(t):
    # each line repeated, so that the sizes reach every band
    text = F.array_join(F.flatten(F.transform(F.split("text", "\n"), lambda x: F.array_repeat(x, 12))), "\n")
    return R.size_score(t.table("documents").select("doc_id", text.alias("text")))


@query(
    "token_variance",
    """WITH x AS (SELECT doc_id, round(abs(n_chars // 4 - CASE WHEN doc_id % 6 > 0 THEN n_chars // 4 + doc_id % 40 END) * 100.0::DOUBLE / nullif(CASE WHEN doc_id % 6 > 0 THEN n_chars // 4 + doc_id % 40 END, 0), 1) AS variance_pct FROM documents)
    SELECT *, CAST(CASE WHEN variance_pct IS NULL THEN 1 WHEN variance_pct <= 5 THEN 5 WHEN variance_pct <= 10 THEN 4 WHEN variance_pct <= 20 THEN 3 WHEN variance_pct <= 40 THEN 2 ELSE 1 END AS BIGINT) AS max_score FROM x""",
)
def _(t):
    actual = F.floor(F.col("n_chars") / 4)
    return R.token_variance(
        t.table("documents").select("doc_id", actual.alias("actual"), F.when(F.col("doc_id") % 6 > 0, actual + F.col("doc_id") % 40).alias("declared"))
    )


@query(
    "structured_ratio",
    f"""WITH {_TEXTS}, l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(x, '#')) AS c FROM rt),
    s AS (SELECT doc_id, len(c) AS content_lines, len(list_filter(c, lambda x: regexp_matches(x, '^\\s*([-*+] |\\d+\\. |\\||```)'))) AS structured_lines FROM l)
    SELECT *, round(structured_lines * 100.0::DOUBLE / nullif(content_lines, 0), 1) AS structured_pct FROM s""",
)
def _(t):
    return R.structured_ratio(review_texts(t))


@query(
    "repeated_passages",
    """WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    w AS (SELECT *, len(regexp_split_to_array(line, '[ \\t]+')) AS n FROM l)
    SELECT doc_id, sha256(line) AS passage, count(*) AS occurrences, min(pos) AS first_line, max(pos) AS last_line, max(n) AS word_count
    FROM w WHERE n > 10 GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _(t):
    return R.repeated_passages(t.table("documents"))


_LINKS = """lk AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)href="([^"]*)"', 1)) AS link FROM pages)"""


@query("page_links", f"WITH {_LINKS} SELECT * FROM lk")
def _(t):
    return R.page_links(t.table("pages"))


def _known_links(t):
    links = R.page_links(t.table("pages"))
    return links.groupBy("link").agg(F.count(F.lit(1)).alias("n")).filter("n % 3 > 0")


@query(
    "reference_validity",
    f"""WITH {_LINKS}, k AS (SELECT link FROM lk GROUP BY 1 HAVING count(*) % 3 > 0),
    x AS (SELECT page_id AS doc_id, count(*) AS total_references, count(*) FILTER (link IN (SELECT link FROM k)) AS valid_references FROM lk GROUP BY 1)
    SELECT *, round(valid_references * 100.0::DOUBLE / total_references, 1) AS valid_pct, round(valid_references * 100.0::DOUBLE / total_references, 1) < 60 AS is_capped FROM x""",
)
def _(t):
    refs = R.page_links(t.table("pages")).select(F.col("page_id").alias("doc_id"), F.col("link").alias("reference"))
    return R.reference_validity(refs, _known_links(t).select(F.col("link").alias("reference")))


@query(
    "link_validity",
    f"""WITH {_LINKS}, s AS (SELECT link, CASE WHEN count(*) % 4 = 0 THEN 404 WHEN count(*) % 4 = 1 THEN 301 ELSE 200 END AS st FROM lk GROUP BY 1),
    x AS (SELECT page_id, count(*) AS total_links, count(*) FILTER (st BETWEEN 200 AND 399) AS valid_links FROM lk JOIN s USING (link) GROUP BY 1),
    y AS (SELECT *, round(valid_links * 100.0::DOUBLE / total_links, 1) AS valid_pct FROM x)
    SELECT *, CAST(CASE {" ".join(f"WHEN valid_pct >= {a} THEN {b}" for a, b in R.LINK_BANDS)} ELSE 0 END AS BIGINT) AS score FROM y""",
)
def _(t):
    links = R.page_links(t.table("pages"))
    n = F.count(F.lit(1)) % 4
    status = links.groupBy("link").agg(F.when(n == 0, 404).when(n == 1, 301).otherwise(200).alias("http_status"))
    return R.link_validity(links, status)


def signal_texts(t):
    """Documents with one of six maintenance notes appended, by document."""
    notes = ["The deprecated old method stays", "This API is end-of-life and no longer supported", "It was replaced by v2, a breaking change. EOL", "", "A legacy api that will be removed", "Removed in version 3; sunsetting now"]
    k = F.col("doc_id")
    return t.table("documents").select("doc_id", F.concat_ws("\n", "text", F.get(F.array(*[F.lit(x) for x in notes]), (k % 6).cast("int"))).alias("text"))


_SIGNAL = """sg AS (SELECT doc_id, concat_ws(chr(10), text, ['The deprecated old method stays', 'This API is end-of-life and no longer supported', 'It was replaced by v2, a breaking change. EOL', '', 'A legacy api that will be removed', 'Removed in version 3; sunsetting now'][CAST(doc_id % 6 AS INT) + 1]) AS text FROM documents)"""


def _count_sql(patterns) -> str:
    return " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in patterns)


@query(
    "deprecation_signals",
    f"""WITH {_SIGNAL}, x AS (SELECT doc_id, {_count_sql(R.HIGH_SIGNALS)} AS high_signals, {_count_sql(R.MEDIUM_SIGNALS)} AS medium_signals FROM sg)
    SELECT *, CASE WHEN high_signals + medium_signals * 0.5 = 0 THEN 0.0::DOUBLE WHEN high_signals + medium_signals * 0.5 <= 1.5 THEN -0.5 WHEN high_signals + medium_signals * 0.5 <= 3 THEN -1.0 ELSE -2.0 END AS penalty FROM x""",
)
def _(t):
    return R.deprecation_signals(signal_texts(t))


def plan_texts(t):
    notes = ["Consider retrying as needed", "Use a large, significant batch if appropriate", "Stop at 500 rows", "yesterday it ran; today it failed", "Last week was fine, recently not"]
    k = F.col("doc_id")
    return t.table("documents").select(
        "doc_id", F.concat_ws("\n", F.get(F.array(*[F.lit(x) for x in notes]), (k % 5).cast("int")), "text").alias("text"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int")).alias("doc_date"),
    )


_PLANS = """pt AS (SELECT doc_id, concat_ws(chr(10), ['Consider retrying as needed', 'Use a large, significant batch if appropriate', 'Stop at 500 rows', 'yesterday it ran; today it failed', 'Last week was fine, recently not'][CAST(doc_id % 5 AS INT) + 1], text) AS text,
  DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS doc_date FROM documents),
  pl AS (SELECT doc_id, doc_date, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM pt)"""


@query(
    "blocking_phrases",
    f"WITH {_PLANS} SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, line, '{c}' AS phrase_class, len(regexp_extract_all(x, '{p}')) AS hits FROM pl" for c, p in R.BLOCKING.items()) + ") WHERE hits > 0",
)
def _(t):
    return R.blocking_phrases(plan_texts(t))


@query(
    "schema_errors",
    """WITH o AS (SELECT doc_id, repeat('[CRITICAL] a' || chr(10), CAST(CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END AS INT)) || repeat('[HIGH] b' || chr(10), CAST(n_chars % 5 AS INT)) || repeat('[INFO] c', CAST(doc_id % 3 AS INT)) || text AS text FROM documents),
    x AS (SELECT doc_id, len(regexp_extract_all(text, '\\[CRITICAL\\]')) AS critical, len(regexp_extract_all(text, '\\[HIGH\\]')) AS high, len(regexp_extract_all(text, '\\[MEDIUM\\]')) AS medium, len(regexp_extract_all(text, '\\[INFO\\]')) AS info FROM o)
    SELECT *, CAST(CASE WHEN critical >= 1 THEN 2 WHEN high >= 3 THEN 3 ELSE 5 END AS BIGINT) AS score_cap FROM x""",
)
def _(t):
    n = F.col("n_chars")
    out = t.table("documents").select(
        "doc_id",
        F.concat(
            F.when(n % 7 == 0, "[CRITICAL] a\n").otherwise(""), F.expr("repeat('[HIGH] b\n', cast(n_chars % 5 as int))"), F.expr("repeat('[INFO] c', cast(doc_id % 3 as int))"), "text"
        ).alias("text"),
    )
    return R.schema_errors(out)


@query(
    "relative_dates",
    f"""WITH {_PLANS}, p AS (SELECT doc_id, doc_date AS d, line, lower(unnest(regexp_extract_all(x, '(?i)\\b(yesterday|today|this morning|last week|recently)\\b', 1))) AS phrase FROM pl)
    SELECT doc_id, line, phrase, CASE phrase WHEN 'yesterday' THEN strftime(d - 1, '%Y-%m-%d') WHEN 'today' THEN strftime(d, '%Y-%m-%d') WHEN 'this morning' THEN strftime(d, '%Y-%m-%d')
      WHEN 'last week' THEN 'week of ' || strftime(date_trunc('week', d) - INTERVAL 7 DAY, '%Y-%m-%d') ELSE 'circa ' || strftime(d, '%Y-%m') END AS resolved FROM p""",
)
def _(t):
    return R.relative_dates(plan_texts(t))


@query(
    "duplicate_content",
    """WITH h AS (SELECT doc_id, sha256(regexp_replace(trim(lower(text), ' '), '\\s+', ' ', 'g')) AS content_hash FROM documents),
    g AS (SELECT content_hash, count(*) AS copies, max(doc_id) AS keeper FROM h GROUP BY 1 HAVING count(*) > 1)
    SELECT doc_id, content_hash, copies, keeper, doc_id = keeper AS is_kept FROM h JOIN g USING (content_hash)""",
)
def _(t):
    return R.duplicate_content(t.table("documents"))


@query(
    "orphan_references",
    f"WITH {_LINKS}, k AS (SELECT link FROM lk GROUP BY 1 HAVING count(*) % 3 > 0) SELECT page_id AS doc_id, link AS reference FROM lk WHERE link NOT IN (SELECT link FROM k)",
)
def _(t):
    refs = R.page_links(t.table("pages")).select(F.col("page_id").alias("doc_id"), F.col("link").alias("reference"))
    return R.orphan_references(refs, _known_links(t).select(F.col("link").alias("reference")))


@query("oversized_indexes", f"SELECT doc_id, {_LINES} AS line_count FROM documents WHERE {_LINES} > 30")
def _(t):
    return R.oversized_indexes(t.table("documents"), limit=30)


@query("near_duplicates")
def _(t):
    return R.near_duplicates(t.table("documents"))
