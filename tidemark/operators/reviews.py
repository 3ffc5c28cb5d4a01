"""Review and document-corpus analytics. Every rule reads the whole text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.exact import as_large, money, numbered, percent, pick_bounded, ranked_values, rounded
from tidemark.functions.sqltext import each
from tidemark.session import durable

# Weights of the dimensions of the three kinds of review.
RULE_WEIGHTS = {
    "actionability": 5, "completeness": 5, "consistency": 3, "parsability": 3, "token_efficiency": 2, "rule_size": 2,
    "staleness": 2, "cross_agent": 1,
}
PLAN_WEIGHTS = {
    "executability": 4, "completeness": 4, "success_criteria": 4, "scope": 3, "dependencies": 2, "decomposition": 1,
    "context": 1, "risk_awareness": 1,
}
DOC_WEIGHTS = {"accuracy": 5, "completeness": 5, "clarity": 4, "structure": 3, "staleness": 2, "consistency": 1}

# Dimensions in a review file with the points each can reach.
REVIEW_DIMENSIONS = {
    "actionability": ("Actionability", 25), "completeness": ("Completeness", 25), "consistency": ("Consistency", 15),
    "parsability": ("Parsability", 15), "token_efficiency": ("Token Efficiency", 10), "staleness": ("Staleness", 10),
}

# Lines up to which a size score holds, with its flag; above the last it is 0.
SIZE_BANDS = (
    (400, 10, ""), (450, 9, ""), (500, 8, ""), (550, 7, "OPTIMIZATION_RECOMMENDED"), (600, 6, "OPTIMIZATION_RECOMMENDED"),
    (650, 5, "SPLITTING_REQUIRED"), (700, 4, "SPLITTING_REQUIRED"), (750, 3, "SPLITTING_REQUIRED"), (800, 2, "NOT_DEPLOYABLE"),
    (900, 1, "NOT_DEPLOYABLE"),
)

# Share of valid links from which a staleness score holds.
LINK_BANDS = ((100, 10), (99, 9), (97, 8), (95, 7), (90, 6), (85, 5), (75, 4), (65, 3), (55, 2), (40, 1))

# Wording of deprecation, by confidence.
HIGH_SIGNALS = (
    r"(?i)\bdeprecated\b.{0,100}\b(function|method|api|endpoint|feature|parameter)\b", r"(?i)\bend[- ]of[- ]life\b", r"(?i)\bEOL\b",
    r"(?i)\bsunset(ted|ting)?\b", r"(?i)\bno longer supported\b", r"(?i)\bremoved in (version|v)?\s*\d", r"(?i)\bbreaking change\b",
)
MEDIUM_SIGNALS = (
    r"(?i)\blegacy\b.{0,50}\b(api|method|approach)\b", r"(?i)\breplaced by\b", r"(?i)\bsuperseded by\b", r"(?i)\bwill be removed\b",
    r"(?i)\bscheduled for removal\b",
)

# Vague wording that blocks execution, by class.
BLOCKING = {
    "ambiguous": r"(?i)\b(consider|if appropriate|as needed|if necessary)\b",
    "undefined_threshold": r"(?i)\b(large|significant|appropriate)\b",
}

RELATIVE_DAY = r"(?i)\b(yesterday|today|this morning|last week|recently)\b"


def ladder(rules: Sequence[tuple[Column, object]], otherwise: object) -> Column:
    out = F.when(rules[0][0], rules[0][1])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def points(weights: Mapping[str, int]) -> Column:
    """Total of raw scores times half their weights; a missing score counts nothing."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * (weight / 2)
    return total


def weighted_score(reviews: DataFrame, weights: Mapping[str, int]) -> DataFrame:
    """Points of each review; needs one raw column per dimension."""
    return reviews.withColumn("total_points", rounded(points(weights), 1))


def verdict(scored: DataFrame, kind: str) -> DataFrame:
    """Verdict by band, with the overrides of critical dimensions and blocking issues.

    Rules are out of 115, plans and documents out of 100.
    """
    p = F.col("total_points")
    low = lambda c: F.col(c) <= 4
    if kind == "rule":
        band = ladder([(p >= 103, "EXECUTABLE"), (p >= 92, "EXECUTABLE_WITH_REFINEMENTS"), (p >= 70, "NEEDS_REFINEMENT")], "NOT_EXECUTABLE")
        return scored.withColumn("verdict", F.when(low("actionability") & low("completeness"), "NOT_EXECUTABLE").otherwise(band))
    names = (
        ["EXCELLENT_PLAN", "GOOD_PLAN", "NEEDS_WORK", "POOR_PLAN", "INADEQUATE_PLAN"]
        if kind == "plan"
        else ["EXCELLENT", "GOOD", "NEEDS_IMPROVEMENT", "POOR", "INADEQUATE"]
    )
    critical = ["executability", "completeness", "success_criteria", "scope"] if kind == "plan" else ["accuracy", "completeness"]
    if kind == "plan":
        blocking = F.coalesce(F.col("blocking_issues"), F.lit(0))
        p = F.when(blocking >= 20, F.least(p, F.lit(40.0))).when(blocking >= 10, F.least(p, F.lit(60.0))).otherwise(p)
    weak = sum((F.when(low(c), 1).otherwise(0) for c in critical), F.lit(0))
    # an override can only lower the band
    level = ladder([(p >= 90, 0), (p >= 80, 1), (p >= 60, 2), (p >= 40, 3)], 4)
    floor = F.when(weak >= 2, 3).when(weak >= 1, 2).otherwise(0)
    at = F.greatest(level, floor)
    return scored.withColumn("capped_points", p).withColumn("verdict", F.get(F.array(*[F.lit(n) for n in names]), at))


def extract_review_metadata(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Overall score, verdict, critical issues and dimension scores out of review texts."""
    t = F.col(text)
    number = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")).cast("bigint")
    after = F.regexp_extract(t, r"(?s)### Critical Issues\s+(.*)", 1)
    section = F.get(F.split(after, "###"), F.lit(0))
    dims = {name: number(rf"\|\s*{label}\s*\|\s*(\d+)/{top}") for name, (label, top) in REVIEW_DIMENSIONS.items()}
    return texts.select(
        key,
        number(r"\*\*Overall:\*\* (\d+)/100").alias("overall_score"),
        F.coalesce(F.nullif(F.regexp_extract(t, r"### Agent Executability Verdict\s+\*\*([A-Z_]+)\*\*", 1), F.lit("")), F.lit("UNKNOWN")).alias("verdict"),
        F.regexp_count(section, F.lit(r"(?m)^\d+\.")).cast("bigint").alias("critical_issues"),
        *[c.alias(n) for n, c in dims.items()],
    )


def extract_timing_blocks(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Run id, human duration and seconds out of the timing table in review texts."""
    pattern = r"(?s)\|\s*Run ID\s*\|\s*`([a-f0-9]+)`\s*\|.*?\|\s*Duration\s*\|\s*(\d+m \d+s)\s*\((\d+\.?\d*)s\)\s*\|"
    part = lambda g: F.regexp_extract(F.col(text), pattern, g)
    return texts.select(
        key, part(1).alias("run_id"), part(2).alias("duration_human"), F.nullif(part(3), F.lit("")).cast("double").alias("duration_seconds")
    ).filter(F.col("run_id") != "")


def timing_block_totals(blocks: DataFrame) -> DataFrame:
    """Number, total and mean of the extracted timings."""
    total = F.sum(money(F.col("duration_seconds"))).cast("double")
    return blocks.agg(
        F.count(F.lit(1)).alias("run_count"), rounded(F.coalesce(total, F.lit(0.0)), 2).alias("total_seconds"),
        rounded(F.coalesce(F.try_divide(total, F.count(F.lit(1))), F.lit(0.0)), 2).alias("avg_seconds"),
    )


def bulk_stats(reviews: DataFrame) -> DataFrame:
    """Reviews, mean, upper median and tiers in one row; reviews without a score count as failed."""
    s = F.col("overall_score")
    scored = reviews.filter(s.isNotNull()).withColumn("scope", F.lit("all"))
    stats = reviews.withColumn("scope", F.lit("all")).groupBy("scope").agg(
        F.count(F.lit(1)).alias("total_reviewed"), F.count(s).alias("successful"), F.count_if(s.isNull()).alias("failed"),
        rounded(F.try_divide(F.sum(s).cast("double"), F.count(s)), 1).alias("average_score"), F.count_if(s >= 90).alias("excellent"),
        F.count_if((s >= 80) & (s < 90)).alias("good"), F.count_if((s >= 60) & (s < 80)).alias("needs_work"), F.count_if(s < 60).alias("poor"),
    )
    return stats.join(ranked_values(scored, ["scope"], "overall_score", {"median_score": 0.5}), "scope", "left").drop("scope")


def verdict_counts(reviews: DataFrame) -> DataFrame:
    """Scored reviews per verdict."""
    return reviews.filter(F.col("overall_score").isNotNull()).groupBy("verdict").agg(F.count(F.lit(1)).alias("review_count"))


def dimension_means(reviews: DataFrame) -> DataFrame:
    """Mean points of each dimension and its share of the possible ones."""
    names = list(REVIEW_DIMENSIONS)
    top = None
    for name, (_, most) in REVIEW_DIMENSIONS.items():
        hit = F.col("dimension") == name
        top = F.when(hit, F.lit(most)) if top is None else top.when(hit, F.lit(most))
    return (
        reviews.filter(F.col("overall_score").isNotNull())
        .select(*names)
        .unpivot([], names, "dimension", "points")
        .filter(F.col("points").isNotNull())
        .groupBy("dimension")
        .agg(rounded(F.sum("points").cast("double") / F.count(F.lit(1)), 1).alias("average"))
        .withColumn("max_points", top.cast("bigint"))
        .withColumn("percentage", rounded(F.col("average") / F.col("max_points") * 100, 1))
    )


def critical_bands(reviews: DataFrame) -> DataFrame:
    """Reviews by number of critical issues, with their share."""
    scored = reviews.filter(F.col("overall_score").isNotNull())
    c = F.col("critical_issues")
    band = F.when(c == 0, "0").when(c <= 2, "1-2").otherwise("3+")
    total = scored.select(F.count(F.lit(1))).scalar()
    return scored.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("review_count")).withColumn("share_pct", percent(F.col("review_count"), total))


def priority_tiers(reviews: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tier of each review and its place in it: worst first, in the top tier best first.

    Scores are few, so the place is counted per score and hash range.
    """
    s = F.col("overall_score")
    tier = F.when(s < 60, 1).when(s < 80, 2).when(s < 90, 3).otherwise(4).cast("bigint")
    rows = reviews.filter(s.isNotNull()).select(key, "overall_score", tier.alias("tier")).withColumn("_s", F.when(F.col("tier") == 4, -s).otherwise(s))
    return numbered(rows, ["tier"], ["_s"], key).drop("_s")


def top_improvements(items: DataFrame, top: int = 10) -> DataFrame:
    """Best improvements by impact for the effort; needs item_id, impact, effort."""
    ratio = rounded(F.try_divide(F.col("impact").cast("double"), F.col("effort")), 4)
    return items.withColumn("ratio", ratio).orderBy(F.desc_nulls_last("ratio"), F.desc("impact"), "item_id").limit(top)


def delta_review(base: DataFrame, current: DataFrame, middle: DataFrame | None = None) -> DataFrame:
    """Issues fixed, open, new or back again between two reviews of a plan.

    All hold (plan_id, issue_id, line, description). Issues meet by id first, then
    by line, then by description, the smallest ids of a line or text first; `middle` lists those that an intermediate version had fixed.
    """
    b = base.select("plan_id", F.col("issue_id").alias("base_id"), F.col("line").alias("base_line"), F.col("description").alias("base_text"))
    c = current.select("plan_id", F.col("issue_id").alias("current_id"), F.col("line").alias("current_line"), F.col("description").alias("current_text"))
    by_id = b.join(c, (b["plan_id"] == c["plan_id"]) & (F.col("base_id") == F.col("current_id"))).select(b["plan_id"], "base_id", "current_id")
    first = lambda df, by, i: df.groupBy("plan_id", F.col(by).alias("_t")).agg(F.min(i).alias(i))
    matched = by_id
    for by in ("line", "text"):
        left = b.join(matched.select("plan_id", "base_id"), ["plan_id", "base_id"], "left_anti")
        right = c.join(matched.select("plan_id", "current_id"), ["plan_id", "current_id"], "left_anti")
        met = first(left, f"base_{by}", "base_id").join(first(right, f"current_{by}", "current_id"), ["plan_id", "_t"])
        matched = matched.unionByName(met.select("plan_id", "base_id", "current_id"))
    fixed_between = (
        base.select("plan_id", F.col("issue_id").alias("base_id")).limit(0)
        if middle is None
        else base.join(middle, ["plan_id", "issue_id"], "left_anti").select("plan_id", F.col("issue_id").alias("base_id"))
    ).withColumn("_gone", F.lit(True))
    kept = matched.join(fixed_between, ["plan_id", "base_id"], "left").select(
        "plan_id", F.col("base_id").alias("issue_id"), F.when(F.col("_gone"), "REGRESSION").otherwise("OPEN").alias("status")
    )
    gone = b.join(matched, ["plan_id", "base_id"], "left_anti").select("plan_id", F.col("base_id").alias("issue_id"), F.lit("FIXED").alias("status"))
    new = c.join(matched, ["plan_id", "current_id"], "left_anti").select("plan_id", F.col("current_id").alias("issue_id"), F.lit("NEW").alias("status"))
    return kept.unionByName(gone).unionByName(new)


def delta_summary(delta: DataFrame) -> DataFrame:
    """Issues per status and the net change of each plan."""
    s = F.col("status")
    return delta.groupBy("plan_id").agg(
        F.count_if(s == "FIXED").alias("fixed"), F.count_if(s == "OPEN").alias("open"), F.count_if(s == "NEW").alias("new"),
        F.count_if(s == "REGRESSION").alias("regressions"),
    ).withColumn("net_change", F.col("fixed") - F.col("new") - F.col("regressions"))


def dimension_delta(base: DataFrame, current: DataFrame) -> DataFrame:
    """Points per dimension of two reviews of a plan and their change, with a TOTAL row per plan.

    Both hold plan_id, dimension and points, one row each. A dimension that one review lacks has no change; the total
    adds what each review has.
    """
    add = lambda df, name: df.groupBy("plan_id", F.coalesce("dimension", F.lit("UNKNOWN")).alias("dimension")).agg(F.sum("points").alias(name))
    per = add(base, "baseline").join(add(current, "current"), ["plan_id", "dimension"], "full")
    total = per.groupBy("plan_id").agg(F.lit("TOTAL").alias("dimension"), F.sum("baseline").alias("baseline"), F.sum("current").alias("current"))
    return per.unionByName(total).withColumn("change", F.col("current") - F.col("baseline"))


def review_variance(reviews: DataFrame, allowed: float = 5.0) -> DataFrame:
    """Spread of the scores of repeated reviews, and the rank of each plan by its mean.

    The rank is counted over distinct means, of which scores allow only a few.
    """
    s = F.col("overall_score")
    per = reviews.filter(s.isNotNull()).groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("review_count"), rounded(F.sum(s).cast("double") / F.count(F.lit(1)), 2).alias("mean_score"),
        (F.max(s) - F.min(s)).cast("double").alias("variance"),
    )


    means = per.groupBy("mean_score").agg(F.count(F.lit(1)).alias("_c"))
    above = Window.orderBy(F.desc("mean_score")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = means.select("mean_score", (F.coalesce(F.sum("_c").over(above), F.lit(0)) + 1).alias("plan_rank"))
    return per.join(ranks, "mean_score").select(
        "plan_id", "review_count", "mean_score", "variance", F.when(F.col("variance") <= allowed, "CONSISTENT").otherwise("HIGH_VARIANCE").alias("status"),
        "plan_rank", (F.col("plan_rank") == 1).alias("is_winner"),
    )


def line_list(text: str) -> Column:
    return F.split(F.col(text), "\n")


def size_score(docs: DataFrame, key: str = "doc_id", text: str = "text", target: int = 500) -> DataFrame:
    """Score and flag by the number of lines, and the distance to the target in percent."""
    n = F.col("line_count")
    score = ladder([(n <= limit, value) for limit, value, _ in SIZE_BANDS], 0)
    flag = ladder([(n <= limit, name) for limit, _, name in SIZE_BANDS], "NOT_DEPLOYABLE")
    return docs.select(key, F.size(line_list(text)).cast("bigint").alias("line_count")).withColumns(
        {"size_score": score.cast("bigint"), "flag": flag, "variance_pct": rounded((n - target) * 100.0 / target, 1)}
    )


def token_variance(docs: DataFrame) -> DataFrame:
    """Distance between declared and actual tokens with its band; needs doc_id, declared, actual."""
    v = rounded(F.try_divide(F.abs(F.col("actual") - F.col("declared")) * 100.0, F.col("declared").cast("double")), 1)
    p = F.col("variance_pct")
    return docs.select("doc_id", v.alias("variance_pct")).withColumn(
        "max_score", ladder([(p.isNull(), 1), (p <= 5, 5), (p <= 10, 4), (p <= 20, 3), (p <= 40, 2)], 1).cast("bigint")
    )


STRUCTURED_LINE = r"^\s*([-*+] |\d+\. |\||```)"


def structured_ratio(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Share of list, table and code lines among the lines with content."""
    content = F.filter(line_list(text), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    return docs.select(key, F.size(content).cast("bigint").alias("content_lines"), F.size(F.filter(content, lambda x: x.rlike(STRUCTURED_LINE))).cast("bigint").alias("structured_lines")).withColumn(
        "structured_pct", percent(F.col("structured_lines"), F.col("content_lines"))
    )


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 10) -> DataFrame:
    """Lines of more than `min_words` words that occur again in the same document."""
    line = F.trim("_line")
    return (
        docs.select(key, F.posexplode(line_list(text)).alias("_pos", "_line"))
        .withColumn("_words", F.size(F.split(line, r"[ \t]+")))
        .filter(F.col("_words") > min_words)
        .groupBy(key, F.sha2(line, 256).alias("passage"))
        .agg(
            F.count(F.lit(1)).alias("occurrences"), (F.min("_pos") + 1).cast("bigint").alias("first_line"),
            (F.max("_pos") + 1).cast("bigint").alias("last_line"), F.max("_words").cast("bigint").alias("word_count"),
        )
        .filter(F.col("occurrences") > 1)
    )


def reference_validity(references: DataFrame, known: DataFrame, cap_below: float = 60.0) -> DataFrame:
    """Share of valid references per document; below the limit the score is capped.

    Both hold `reference`; `references` also doc_id.
    """
    k = known.select("reference").distinct().withColumn("_k", F.lit(True))
    return references.join(k, "reference", "left").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_references"), F.count_if(F.coalesce("_k", F.lit(False))).alias("valid_references")
    ).withColumn("valid_pct", percent(F.col("valid_references"), F.col("total_references"))).withColumn("is_capped", F.col("valid_pct") < cap_below)


HREF = r"""(?i)href="([^"]*)\""""


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct links of each page."""
    return pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), 1))).alias("link"))


def link_validity(links: DataFrame, status: DataFrame) -> DataFrame:
    """Share of links that answer per page, with its score; `status` holds (link, http_status)."""
    p = F.col("valid_pct")
    return (
        links.join(status, "link", "left")
        .groupBy("page_id")
        .agg(F.count(F.lit(1)).alias("total_links"), F.count_if(F.coalesce(F.col("http_status").between(200, 399), F.lit(False))).alias("valid_links"))
        .withColumn("valid_pct", percent(F.col("valid_links"), F.col("total_links")))
        .withColumn("score", ladder([(p >= limit, value) for limit, value in LINK_BANDS], 0).cast("bigint"))
    )


def _hits(text: str, patterns: Sequence[str]) -> Column:
    return sum((F.regexp_count(text, F.lit(p)) for p in patterns), F.lit(0)).cast("bigint")


def deprecation_signals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deprecation wording per document and the penalty for it."""
    total = F.col("high_signals") + F.col("medium_signals") * 0.5
    return docs.select(key, _hits(text, HIGH_SIGNALS).alias("high_signals"), _hits(text, MEDIUM_SIGNALS).alias("medium_signals")).withColumn(
        "penalty", F.when(total == 0, 0.0).when(total <= 1.5, -0.5).when(total <= 3, -1.0).otherwise(-2.0)
    )


def blocking_phrases(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Vague phrases per line and class."""
    lines = docs.select(key, F.posexplode(line_list(text)).alias("_pos", "_line"))
    counts = [F.struct(F.lit(c).alias("phrase_class"), F.regexp_count("_line", F.lit(p)).cast("bigint").alias("hits")) for c, p in BLOCKING.items()]
    return lines.select(key, (F.col("_pos") + 1).cast("bigint").alias("line"), F.explode(F.array(*counts)).alias("_h")).select(
        key, "line", "_h.phrase_class", "_h.hits"
    ).filter("hits > 0")


def schema_errors(outputs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Messages per severity and the cap they put on a score."""
    count = lambda s: F.regexp_count(text, F.lit(rf"\[{s}\]")).cast("bigint")
    return outputs.select(key, *[count(s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "INFO")]).withColumn(
        "score_cap", F.when(F.col("critical") >= 1, 2).when(F.col("high") >= 3, 3).otherwise(5).cast("bigint")
    )


def relative_dates(docs: DataFrame, key: str = "doc_id", text: str = "text", day: str = "doc_date") -> DataFrame:
    """Relative date words per line with the day or week they mean, seen from the date of the document."""
    words = docs.select(key, day, F.posexplode(line_list(text)).alias("_pos", "_line")).select(
        key, day, (F.col("_pos") + 1).cast("bigint").alias("line"),
        F.explode(F.transform(F.regexp_extract_all("_line", F.lit(RELATIVE_DAY), 1), F.lower)).alias("phrase"),
    )
    p, d = F.col("phrase"), F.col(day)
    resolved = (
        F.when(p == "yesterday", F.date_format(F.date_sub(d, 1), "yyyy-MM-dd"))
        .when(p.isin("today", "this morning"), F.date_format(d, "yyyy-MM-dd"))
        .when(p == "last week", F.concat(F.lit("week of "), F.date_format(F.date_sub(F.trunc(d, "week"), 7), "yyyy-MM-dd")))
        .otherwise(F.concat(F.lit("circa "), F.date_format(d, "yyyy-MM")))
    )
    return words.withColumn("resolved", resolved).select(key, "line", "phrase", "resolved")


def duplicate_content(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with the same content, spaces and case aside; the newest of each group stays.

    A group is told by its hash, so no task ever holds the copies of one text.
    """
    shape = F.sha2(F.regexp_replace(F.trim(F.lower(text)), r"\s+", " "), 256)
    hashed = docs.select(key, shape.alias("content_hash"))
    groups = hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.max(key).alias("keeper")).filter("copies > 1")
    return hashed.join(groups, "content_hash").withColumn("is_kept", F.col(key) == F.col("keeper"))


def shingle_sets(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Hashed word shingles of each distinct text; of equal texts the newest document stands for all.

    copy tells the texts of one document apart, if any has several; it is 0 otherwise, since each shingle carries it.
    """
    repeated = docs.groupBy(key).count().filter("count > 1").limit(1).count() > 0
    shape = F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")
    distinct = docs.select(F.col(key).alias("doc"), shape.alias("_t")).groupBy(F.sha2("_t", 256).alias("_h")).agg(
        F.max("doc").alias("doc"), F.max_by("_t", "doc").alias("_t")
    )
    # the words are a column of their own: inside the lambda below a split would run once per shingle
    copy = F.xxhash64("_h") if repeated else F.lit(0).cast("bigint")
    words = distinct.select("doc", copy.alias("copy"), F.split("_t", " ").alias("_w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - size + 1, F.lit(1)))
    spans = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("_w", i, size), " ")))
    return words.select("doc", "copy", F.array_distinct(spans).alias("shingles")).withColumn("n", F.size("shingles"))


PARITY = [f"_p{i}" for i in range(4)]  # 64 cells each


def shared_sets(sets: DataFrame, min_similarity: float) -> DataFrame:
    """Sets that may be like another one: their shingles found in other sets too, rarest first, and how many to look up (room).

    A shingle of one set only is never common to two, so these are counted and left out, and so is a set that has too many
    of them. Shingles are shuffled once, by shingle; how many sets hold one is counted where they meet. The parity columns
    say for each of 256 hashed cells whether an odd number of the shingles falls into it.
    """
    held = each(sets, F.col("shingles"), "s", "doc", "copy", "n")
    met = held.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("s"))).filter("df > 1 and doc is not null")
    # two flat lists, filled row by row together, are half the size of a list of pairs
    lists = met.groupBy("doc", "copy", "n").agg(F.collect_list(F.col("df").cast("int")).alias("df"), F.collect_list("s").alias("s"))
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(min_similarity) - 1e-9) + 1
    room = (prefix - (F.col("n") - F.size("s"))).cast("int")  # shingles of one document come first
    ordered = lists.withColumn("room", room).filter("room > 0").select("doc", "n", "room", F.array_sort(F.arrays_zip("df", "s")).getField("s").alias("shared"))

    def parity(i: int) -> Column:
        bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("bigint"), s.bitwiseAND(63).cast("int"))
        odd = lambda bits, s: F.when(s.bitwiseAND(0xC0) == i << 6, bits.bitwiseXOR(bit(s))).otherwise(bits)
        return F.aggregate("shared", F.lit(0).cast("bigint"), odd)

    return ordered.select("doc", "n", "room", "shared", *[parity(i).alias(p) for i, p in enumerate(PARITY)])


def newest_alike(pairs: DataFrame, sets: DataFrame, min_similarity: float) -> DataFrame:
    """doc, keeper and similarity: of the pairs (doc, rep), the newest rep of each doc that is alike by the whole sets.

    Documents are compared with their newest rep first, and only those that are not like it with some more of the next
    ones: sets are not sent along for comparisons that cannot count any more. rank: of a rep, from the newest.
    """
    found, upto = None, 1
    while found is None or not pairs.isEmpty():
        ids = pairs.select("doc").union(pairs.select("rep")).distinct()
        sets = durable(sets.join(as_large(ids), "doc", "left_semi").select("doc", "n", "shared"))
        a = sets.select("doc", F.col("shared").alias("_a"), F.col("n").alias("_na"))
        b = sets.select(F.col("doc").alias("rep"), F.col("shared").alias("_b"), F.col("n").alias("_nb"))
        same = F.size(F.array_intersect("_a", "_b"))
        alike = (
            pairs.filter(F.col("rank") <= upto).join(as_large(a), "doc").join(as_large(b), "rep")
            .select("doc", "rep", (same / (F.col("_na") + F.col("_nb") - same)).alias("_j"))
            .filter(F.col("_j") >= min_similarity)
            .groupBy("doc")
            .agg(F.max(F.struct("rep", "_j")).alias("_m"))
        )
        hits = durable(alike.select("doc", F.col("_m.rep").alias("keeper"), rounded(F.col("_m._j"), 4).alias("similarity")))
        found = hits if found is None else found.unionByName(hits)
        pairs = durable(pairs.filter(F.col("rank") > upto).join(as_large(hits.select("doc")), "doc", "left_anti"))
        upto *= 8
    return found


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_similarity: float = 0.8, shingle: int = 3, reps: int = 32
) -> DataFrame:
    """Documents that are nearly equal to a newer one, with that one and the exact similarity.

    Afterwards no two documents that stay are alike, and each one given here has a
    newer one like it. Sets at least t alike share one of the n - ceil(t n) + 1
    rarest shingles of either, so only these meet. Documents of one shingle are not
    compared with each other but with its newest `reps`; these leave the shingle,
    and the rest goes on to the next round until nothing is left to compare. A
    thousand near copies so cost a thousand comparisons, not half a million.

    Where two documents meet, their sizes and the parities of their shingles bound
    what they can share: cells of different parity hold a shingle of one of them.
    Only pairs that may be alike by that bound are written and compared as a whole.
    While there are none, the number of heads doubles.
    """
    sets = durable(shared_sets(shingle_sets(docs, key, text, shingle), min_similarity))
    brief = ["doc", "n", F.size("shared").alias("m"), *PARITY]
    postings = sets.select(*brief, F.explode(F.slice("shared", F.lit(1), F.col("room"))).alias("s"))
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"_r{p}"))) for p in PARITY), F.lit(0))
    most = F.least("m", "_rm", F.floor((F.col("m") + F.col("_rm") - apart) / 2))
    near = F.least("n", "_rn") >= F.greatest("n", "_rn") * min_similarity - 1e-9
    may = near & (most >= (F.col("n") + F.col("_rn") - most) * F.lit(min_similarity) - 1e-6)
    newest = Window.partitionBy("doc").orderBy(F.desc("rep"))
    found, tested, wide = None, None, reps
    while True:
        heads = pick_bounded(postings, ["s"], [F.desc("doc")], wide).drop("_rn")
        heads = heads.withColumnsRenamed({"doc": "rep", **{c: f"_r{c}" for c in ("n", "m", *PARITY)}})
        pairs = postings.join(as_large(heads), "s").filter((F.col("doc") < F.col("rep")) & may).select("doc", "rep").distinct()
        if tested is not None:
            pairs = pairs.join(as_large(tested), ["doc", "rep"], "left_anti")
        pairs = durable(pairs.withColumn("rank", F.row_number().over(newest)))
        some = not pairs.isEmpty()
        if some and wide > reps:  # hits are to leave before the next `reps` heads are chosen
            wide = reps
            continue
        # shingles with no more than `wide` documents are done; of the others those older than the heads are left
        full = heads.groupBy("s").agg(F.min("rep").alias("_last"), F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= wide)
        rest = postings.join(as_large(full.select("s", "_last")), "s").filter(F.col("doc") < F.col("_last")).drop("_last")
        if found is None or some:
            if found is not None:
                sets = durable(sets.join(as_large(postings.select("doc").distinct()), "doc", "left_semi"))
            hits = newest_alike(pairs, sets, min_similarity)
            rest = rest.join(as_large(hits.select("doc")), "doc", "left_anti")
            found = hits if found is None else found.unionByName(hits)
            tested = pairs.select("doc", "rep") if tested is None else tested.unionByName(pairs.select("doc", "rep"))
        postings = durable(rest)
        wide = reps if some else 2 * wide  # rounds without a pair that may be alike choose as if they were one
        if postings.isEmpty():
            return found.withColumnRenamed("doc", key)


def orphan_references(references: DataFrame, known: DataFrame) -> DataFrame:
    """References whose target no longer exists."""
    return references.join(known.select("reference").distinct(), "reference", "left_anti").select("doc_id", "reference")


def oversized_indexes(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 200) -> DataFrame:
    """Index documents with more lines than allowed."""
    return docs.select(key, F.size(line_list(text)).cast("bigint").alias("line_count")).filter(F.col("line_count") > limit)
