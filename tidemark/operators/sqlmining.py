"""Mining of SQL text in a query log: tables, columns, metrics, patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import head, one_row, percent, pick_bounded, text_list
from tidemark.functions.sqltext import (
    AGGREGATE_CALL,
    column_references,
    each,
    extract_tables,
    is_write_text,
    normalized_text,
    strip_comments,
    table_class,
)
from tidemark.operators.usage import THREE_PART_NAME, since

WRITE_REASON = "DML/DDL operation detected"

# Business domains and the words in table names that stand for them, in rule order.
DOMAIN_WORDS = (
    ("SUBSCRIBER/CUSTOMER", "subscriber|customer|account|person"),
    ("ORDER_MANAGEMENT", "order|fulfillment|orchestration"),
    ("BILLING", "transaction|billing|payment|invoice|mrc"),
    ("NETWORK/USAGE", "cdr|usage|network|tower|signal"),
    ("CHURN/RETENTION", "churn|retention|risk|propensity"),
    ("DEVICE/INVENTORY", "device|imei|inventory|serial"),
    ("CARE/SUPPORT", "case|incident|interaction|care|contact"),
    ("PORTING/MIGRATION", "port|switch|migration"),
    ("WORKFORCE", "schedule|workforce|agent|employee"),
)

# Patterns of replication, metadata and session-setup statements.
NOISE = (
    r"(?s)ATTREP_CHANGES|REPLICATE_OP|INFORMATION_SCHEMA\.(DATABASES|COLUMNS)|SYSTEM\$(AUTHORIZE|BOOTSTRAP)"
    r"|_STAGE_STREAM.*LATERAL FLATTEN"
)
WRITE_PATTERN = r"^\s*(INSERT\s+INTO|DELETE\s+FROM|MERGE\s+INTO)"
ANALYTIC = r"\bJOIN\b|GROUP\s+BY|\b(SUM|COUNT|AVG|MIN|MAX)\s*\(|CASE\s+WHEN|OVER\s*\("

# Kinds of semi-structured access and the patterns that show them.
SEMI_STRUCTURED = (
    ("json_parse", r"(?i)(TRY_)?PARSE_JSON\s*\("),
    ("path_access", r"(?i)\w+:\w+"),
    ("flatten", r"(?i)LATERAL\s+FLATTEN\s*\("),
    ("construct", r"(?i)(OBJECT_CONSTRUCT|ARRAY_AGG)\s*\("),
)

# Words that cannot be a candidate table or column.
NOT_A_CANDIDATE_TABLE = ("SELECT", "WHERE", "FROM", "JOIN", "ON", "AND", "OR", "AS", "NULL")
NOT_A_CANDIDATE_COLUMN = (
    "FROM", "WHERE", "JOIN", "NULL", "TRUE", "FALSE", "CASE", "WHEN", "THEN", "ELSE", "END", "LIMIT",
)
CANDIDATE_TABLE = r"(?i)(?:FROM|JOIN)\s+(?:[A-Z0-9_$]+\.){0,2}([A-Z0-9_$]+)"
CANDIDATE_COLUMN = r"(?i)(?:WHERE|AND|OR|GROUP BY|ORDER BY|SELECT)[\s,]+([A-Z_][A-Z0-9_]+)"
SEARCH_FILTER = r"(?is)FILTER.*?([A-Z_]+)\s*="


def write_filter(log: DataFrame) -> DataFrame:
    """Each query with its text free of comments and a flag for writes."""
    return log.select("query_id", strip_comments("query_text").alias("clean_text")).withColumn(
        "is_write", is_write_text("clean_text")
    )


def process_queries(log: DataFrame) -> DataFrame:
    """Tables and alias.column pairs per query; writes are kept but marked as skipped."""
    skipped = F.col("skipped")
    pair = "array<struct<alias:string,name:string>>"
    # comments are removed once per text, ahead of the rules that read it
    clean = log.select(
        F.col("query_id").alias("index"), "domain", "question", strip_comments("query_text").alias("_clean")
    ).withColumn("skipped", is_write_text("_clean"))
    return clean.select(
        "index",
        "domain",
        "question",
        "skipped",
        F.when(skipped, WRITE_REASON).alias("reason"),
        F.when(skipped, F.array().cast("array<string>")).otherwise(extract_tables("_clean")).alias("tables"),
        F.when(skipped, F.array().cast(pair)).otherwise(column_references("_clean")).alias("columns"),
    )


def query_columns(processed: DataFrame) -> DataFrame:
    """Sorted distinct columns per query and alias."""
    return (
        each(processed, F.col("columns"), "c", "index")
        .select("index", "c.alias", "c.name")
        .groupBy("index", "alias")
        .agg(text_list(F.col("name")).alias("columns"))
    )


def table_usage(processed: DataFrame) -> DataFrame:
    """One row per table and query that uses it, with the class of the table.

    The list of queries per table stays in rows: a popular table may be used by
    a third of the log, too much for one array.
    """
    used = each(processed, F.col("tables"), "table_name", "index")  # a write has none
    return used.select("table_name", F.col("index").alias("query_index")).withColumn("table_class", table_class(F.col("table_name")))


def consolidate_tables(processed: DataFrame) -> DataFrame:
    """Class, number of uses, first and last query per table."""
    return (
        table_usage(processed)
        .groupBy("table_name", "table_class")
        .agg(
            F.count(F.lit(1)).alias("used_in_queries"),
            F.min("query_index").alias("first_query"),
            F.max("query_index").alias("last_query"),
        )
    )


def extraction_summary(processed: DataFrame) -> DataFrame:
    """Totals of one extraction run in a single row."""
    tables = consolidate_tables(processed).agg(
        F.count(F.lit(1)).alias("unique_tables"),
        F.count_if(F.col("table_class") == "dimension").alias("dimension_tables"),
        F.count_if(F.col("table_class") == "fact").alias("fact_tables"),
        F.count_if(F.col("table_class") == "other").alias("other_tables"),
    )
    names = tables.columns
    return processed.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(~F.col("skipped")).alias("processed"),
        F.count_if("skipped").alias("skipped"),
    ).withColumn("_t", one_row(tables)).select(
        "total_queries", "processed", "skipped", *[F.col("_t")[c].alias(c) for c in names]
    )


def domain_usage(processed: DataFrame) -> DataFrame:
    """Queries and distinct tables per domain; a blank domain counts as Unknown."""
    live = processed.filter(~F.col("skipped")).withColumn("domain", named_domain(F.col("domain")))
    counts = live.groupBy("domain").agg(F.count(F.lit(1)).alias("query_count"))
    tables = (
        each(processed.withColumn("domain", named_domain(F.col("domain"))), F.col("tables"), "t", "domain").distinct().groupBy("domain").agg(
            F.count(F.lit(1)).alias("table_count")
        )
    )
    return counts.join(tables, "domain", "left").fillna(0, ["table_count"])


def named_domain(domain: Column) -> Column:
    return F.when(F.coalesce(domain, F.lit("")) == "", "Unknown").otherwise(domain)


def shared_tables(processed: DataFrame) -> DataFrame:
    """Tables used in more than one domain, with the sorted domains."""
    return (
        each(processed.withColumn("domain", named_domain(F.col("domain"))), F.col("tables"), "table_name", "domain")
        .distinct()
        .groupBy("table_name")
        .agg(F.count(F.lit(1)).alias("domain_count"), text_list(F.col("domain")).alias("domains"))
        .filter(F.col("domain_count") > 1)
    )


def domain_tables(processed: DataFrame) -> DataFrame:
    """Each table of each domain with the number of queries that use it there."""
    named = processed.withColumn("domain", named_domain(F.col("domain")))
    return each(named, F.col("tables"), "table_name", "domain", "index").groupBy("domain", "table_name").agg(F.count_distinct("index").alias("query_count"))


def shared_table_queries(processed: DataFrame) -> DataFrame:
    """Queries of each table that is used in more than one domain, one row per table and query."""
    named = processed.withColumn("domain", named_domain(F.col("domain")))
    used = each(named, F.col("tables"), "table_name", "domain", "index").select("table_name", "domain", F.col("index").alias("query_index"))
    return used.distinct().join(shared_tables(processed).select("table_name"), "table_name", "left_semi")


def mine_metrics(log: DataFrame, max_length: int | None = None, samples: int = 3) -> DataFrame:
    """Metrics per domain from aggregate calls: most frequent expression, uses, sample questions.

    Calls are counted per expression first, so the choice of an expression and of
    the samples runs over distinct texts only. Expressions over `max_length`
    (100 is usual) are left out; None keeps all.
    """
    text = F.col("query_text")
    calls = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(AGGREGATE_CALL), g) for g in (1, 2, 3)])
    c = each(log.withColumn("domain", named_domain(F.col("domain"))), calls, "c", "domain", "question").select(
        "domain",
        "question",
        F.col("c").getField("0").alias("func"),
        F.col("c").getField("1").alias("dist"),
        F.trim(F.col("c").getField("2")).alias("arg"),
    )
    star = F.col("arg").isin("*", "1")
    tail = F.regexp_extract("arg", r"([a-zA-Z_][a-zA-Z0-9_]*)\s*$", 1)
    fits = F.lit(True) if max_length is None else F.length("arg") <= max_length
    named = c.filter(fits & (star | (tail != ""))).select(
        "domain",
        "question",
        F.concat(F.lower("func"), F.when(star, "_all").otherwise(F.concat(F.lit("_"), F.lower(tail)))).alias("metric_name"),
        F.concat(F.upper("func"), F.lit("("), F.when(F.col("dist") != "", "DISTINCT ").otherwise(""), "arg", F.lit(")")).alias(
            "expr"
        ),
    )
    key = ["domain", "metric_name"]
    per_expr = named.groupBy(*key, "expr").agg(F.count(F.lit(1)).alias("_n"))
    chosen = per_expr.groupBy(*key).agg(
        F.min_by("expr", F.struct(-F.col("_n"), F.col("expr"))).alias("expr"), F.sum("_n").alias("usage_count")
    )
    asked = pick_bounded(named.select(*key, "question").distinct(), key, [F.col("question")], samples)
    sample = asked.groupBy(*key).agg(text_list(F.col("question"), " | ").alias("sample_questions"))
    return chosen.join(sample, key)


def aggregated_columns(log: DataFrame, top: int = 50) -> DataFrame:
    """Arguments of the first aggregate call of each query, most frequent first."""
    arg = F.upper(F.trim(F.regexp_extract("query_text", r"(?i)(?:SUM|COUNT|AVG|MIN|MAX)\s*\(\s*([^)]+)\)", 1)))
    return (
        log.groupBy(arg.alias("aggregated_column"))
        .agg(F.count(F.lit(1)).alias("frequency"))
        .filter(F.col("aggregated_column") != "")
        .orderBy(F.desc("frequency"), "aggregated_column")
        .limit(top)
    )


def verified_queries(log: DataFrame, per_domain: int | None = None, onboarding: int = 5) -> DataFrame:
    """Queries that have both a question and a read-only text: all, or the first `per_domain` (50 is usual).

    The first `onboarding` of a domain are marked.
    """
    reads = lambda text: (text != "") & ~(text.contains("CREATE") | text.contains("UPDATE") | text.contains("DELETE"))
    only_reads = F.exists(F.array(F.upper("query_text")), reads)  # a text that is derived is derived once, not for each condition
    usable = log.filter((F.col("question") != "") & only_reads).withColumn("domain", named_domain(F.col("domain")))
    if per_domain is not None:
        usable = pick_bounded(usable, ["domain"], [F.col("query_id")], per_domain).drop("_rn")
    keys = usable.select("domain", "query_id").distinct()
    marked = pick_bounded(keys, ["domain"], [F.col("query_id")], onboarding).select("domain", "query_id", F.lit(True).alias("_first"))
    return usable.join(marked, ["domain", "query_id"], "left").select(
        "domain",
        F.concat(F.lit("vqr_"), F.col("query_id").cast("string")).alias("name"),
        "question",
        F.col("query_text").alias("sql"),
        F.coalesce("_first", F.lit(False)).alias("use_as_onboarding_question"),
    )


def touching(log: DataFrame, known_pattern: str, as_of: str, days: int) -> DataFrame:
    """Successful queries in the look-back that mention any known table."""
    return log.filter(
        since("start_time", as_of, days) & (F.col("status") == "SUCCESS") & F.upper("query_text").rlike(known_pattern)
    )


def candidate_tables(
    log: DataFrame,
    known_pattern: str,
    as_of: str,
    days: int = 90,
    per_query: int | None = None,
    min_queries: int = 5,
    top: int = 15,
) -> DataFrame:
    """Tables used together with the known ones but not among them, with their share of the queries.

    Every name of a text counts, or its first `per_query` (20 is usual).
    """
    base = touching(log, known_pattern, as_of, days)
    population = base.select(F.count_distinct("query_id")).scalar()
    found = F.transform(head(F.regexp_extract_all("query_text", F.lit(CANDIDATE_TABLE), 1), per_query), F.upper)
    refs = each(base, F.array_distinct(found), "candidate_table", "query_id", "user_name").filter(
        (F.length("candidate_table") > 3)
        & ~F.col("candidate_table").isin(*NOT_A_CANDIDATE_TABLE)
        & ~F.col("candidate_table").rlike(known_pattern)
    )
    return (
        refs.groupBy("candidate_table")
        .agg(F.count_distinct("query_id").alias("query_count"), F.count_distinct("user_name").alias("unique_users"))
        .filter(F.col("query_count") >= min_queries)
        .orderBy(F.desc("query_count"), "candidate_table")
        .limit(top)
        .withColumn("pct_of_queries", percent(F.col("query_count"), population))
    )


def candidate_columns(
    log: DataFrame,
    known_pattern: str,
    known_columns: Sequence[str],
    as_of: str,
    days: int = 90,
    per_query: int | None = None,
    min_queries: int = 3,
    top: int = 20,
) -> DataFrame:
    """Columns used in queries over the known tables but unknown there, with how they are used.

    Every name of a text counts, or its first `per_query` (30 is usual).
    """
    base = touching(log, known_pattern, as_of, days)
    found = F.transform(head(F.regexp_extract_all("query_text", F.lit(CANDIDATE_COLUMN), 1), per_query), F.upper)
    refs = each(base.withColumn("_t", F.upper("query_text")), F.array_distinct(found), "candidate_col", "query_id", "user_name", "_t").filter(
        (F.length("candidate_col") > 3)
        & ~F.col("candidate_col").isin(*NOT_A_CANDIDATE_COLUMN)
        & ~F.col("candidate_col").isin(*known_columns)
    )

    def after(word: str) -> Column:
        at = F.instr(F.col("_t"), word)
        return (at > 0) & (F.instr(F.substring(F.col("_t"), at + len(word), F.length("_t")), F.col("candidate_col")) > 0)

    context = F.when(after("WHERE") | after("AND"), "filter").when(after("GROUP BY"), "group_by").otherwise("select")
    return (
        refs.withColumn("_c", context)
        .groupBy("candidate_col")
        .agg(
            F.count_distinct("query_id").alias("query_count"),
            F.count_distinct("user_name").alias("unique_users"),
            text_list(F.col("_c"), ", ").alias("usage_contexts"),
        )
        .filter(F.col("query_count") >= min_queries)
        .orderBy(F.desc("query_count"), "candidate_col")
        .limit(top)
    )


def search_filter_columns(
    log: DataFrame, indexed: Sequence[str], as_of: str, days: int = 90, per_query: int | None = None, add_from: int = 5
) -> DataFrame:
    """Columns filtered on in search calls that the search index lacks; `per_query` of a text at most (10 is usual)."""
    found = head(F.regexp_extract_all("query_text", F.lit(SEARCH_FILTER), 1), per_query)
    return (
        log.filter(
            since("start_time", as_of, days) & (F.col("status") == "SUCCESS") & F.upper("query_text").contains("SEARCH_PREVIEW")
        )
        .select(F.explode(F.transform(found, F.upper)).alias("filter_col"))
        .filter(~F.col("filter_col").isin(*indexed))
        .groupBy("filter_col")
        .agg(F.count(F.lit(1)).alias("usage_count"))
        .filter(F.col("usage_count") >= 2)
        .withColumn("recommendation", F.when(F.col("usage_count") >= add_from, "ADD").otherwise("REVIEW"))
    )


def query_patterns(
    log: DataFrame, as_of: str, days: int = 90, min_length: int = 50, max_length: int | None = None, top: int | None = 30
) -> DataFrame:
    """Normalized query texts with their executions, users, and first and last time; texts below `max_length` characters, if given."""
    pattern = F.sha2(normalized_text("query_text"), 256)
    found = (
        log.filter(since("start_time", as_of, days))
        .groupBy(pattern.alias("pattern_hash"))
        .agg(
            F.min_by("query_text", "query_id").alias("query_text"),
            F.min("user_name").alias("sample_user"),
            F.count(F.lit(1)).alias("execution_count"),
            F.count_distinct("user_name").alias("distinct_users"),
            F.min("start_time").alias("first_seen"),
            F.max("start_time").alias("last_seen"),
        )
        .filter(
            (F.length("query_text") > min_length)
            & (F.lit(True) if max_length is None else F.length("query_text") < max_length)
            & F.upper("query_text").contains("SELECT")
        )
    )
    return found if top is None else found.orderBy(F.desc("execution_count"), "pattern_hash").limit(top)


def drop_noise(patterns: DataFrame, broad_users: int = 3) -> DataFrame:
    """Analyst patterns: no replication, metadata, session or write statements."""
    text = F.upper("query_text")
    analytic = text.rlike(r"^\s*SELECT") & text.rlike(ANALYTIC)
    return patterns.filter(
        ~text.rlike(NOISE) & ~text.rlike(WRITE_PATTERN) & (analytic | (F.col("distinct_users") >= broad_users))
    )


def pattern_features(patterns: DataFrame) -> DataFrame:
    """Tables, filtered columns, aggregates, grouping, CASE count, aliases and CTE names per pattern."""

    def found(pattern: str, group: int = 1) -> Column:
        hits = F.regexp_extract_all("query_text", F.lit(pattern), group)
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, F.upper))), ",")

    return patterns.select(
        "pattern_hash",
        found(f"({THREE_PART_NAME})").alias("tables"),
        found(r"(?i)(?:WHERE|AND)\s+([A-Z_][A-Z0-9_.]*)\s*(?:=|>|<|IS|IN|LIKE)").alias("filter_columns"),
        found(r"(?i)((?:SUM|COUNT|AVG|MIN|MAX)\s*\([^)]*\))").alias("aggregates"),
        found(r"(?i)GROUP\s+BY\s+([A-Z0-9_.]+)").alias("group_by"),
        F.regexp_count("query_text", F.lit(r"(?i)CASE\s+WHEN")).cast("bigint").alias("case_count"),
        found(r"(?i)\)\s+AS\s+([A-Z_][A-Z0-9_]*)").alias("aliases"),
        found(r"(?i)(?:WITH|,)\s+([A-Z_][A-Z0-9_]*)\s+AS\s*\(").alias("ctes"),
    )


def pattern_domain(text: Column) -> Column:
    """First business domain whose words occur in a text."""
    ladder = None
    for name, words in DOMAIN_WORDS:
        hit = F.lower(text).rlike(words)
        ladder = F.when(hit, name) if ladder is None else ladder.when(hit, name)
    return ladder


def domain_heat_map(patterns: DataFrame) -> DataFrame:
    """Unique patterns and largest number of users per business domain."""
    tables = F.array_join(F.regexp_extract_all("query_text", F.lit(f"({THREE_PART_NAME})"), 1), " ")
    return (
        patterns.groupBy(F.coalesce(pattern_domain(tables), F.lit("OTHER")).alias("business_domain"))
        .agg(F.count(F.lit(1)).alias("pattern_count"), F.max("distinct_users").alias("max_users"))
    )


def cross_db_chains(patterns: DataFrame) -> DataFrame:
    """Ordered chains of databases named by one pattern, when there are at least two."""
    names = F.regexp_extract_all("query_text", F.lit(f"({THREE_PART_NAME})"), 1)
    dbs = F.array_distinct(F.transform(names, lambda n: F.upper(F.split_part(n, F.lit("."), F.lit(1)))))
    return (
        patterns.withColumn("_d", dbs)
        .filter(F.size("_d") >= 2)
        .groupBy(F.array_join("_d", " -> ").alias("chain"), F.size("_d").alias("_n"))
        .agg(F.count(F.lit(1)).alias("pattern_count"), F.max("distinct_users").alias("max_users"))
        .select("chain", "pattern_count", "max_users", F.when(F.col("_n") == 2, "direct").otherwise("transitive").alias("kind"))
    )


def semi_structured_usage(patterns: DataFrame) -> DataFrame:
    """Patterns, executions and users per kind of semi-structured access."""
    kinds = F.array_compact(
        F.array(*[F.when(F.col("query_text").rlike(p), F.lit(kind)) for kind, p in SEMI_STRUCTURED])
    )
    return (
        patterns.select(F.explode(kinds).alias("kind"), "execution_count", "distinct_users")
        .groupBy("kind")
        .agg(
            F.count(F.lit(1)).alias("pattern_count"),
            F.sum("execution_count").alias("execution_count"),
            F.max("distinct_users").alias("max_users"),
        )
    )


def coverage_gaps(
    heat: DataFrame, volume: DataFrame, high_volume: int = 1000, low_patterns: int = 5, many_users: int = 10
) -> DataFrame:
    """Domains whose query volume and number of patterns do not fit together."""
    both = volume.join(heat, "business_domain", "full_outer").fillna(0, ["pattern_count", "max_users", "query_count"])
    return both.select(
        "business_domain",
        "query_count",
        "pattern_count",
        "max_users",
        F.when(F.col("pattern_count") == 0, "NO_PATTERNS")
        .when((F.col("query_count") >= high_volume) & (F.col("pattern_count") <= low_patterns), "HIGH_VOLUME_LOW_COVERAGE")
        .when((F.col("pattern_count") <= low_patterns) & (F.col("max_users") >= many_users), "FEW_PATTERNS_MANY_USERS")
        .otherwise("COVERED")
        .alias("gap"),
    )


def operational_signals(patterns: DataFrame, frequent: int = 10000) -> DataFrame:
    """Signs of real-time, regulated, cross-product or very frequent use per pattern."""
    text = F.upper("query_text")
    return patterns.select(
        "pattern_hash",
        text.rlike(r">=\s*CURRENT_DATE|DATEADD\(\s*MIN").alias("real_time"),
        text.rlike(r"\b(E?911|PII|AUDIT|COMPLIANCE|REGULATORY)\b").alias("compliance"),
        (text.rlike(r"\bJOIN\b") & text.rlike(r"(SUBSCRIBER|CUSTOMER|ACCT|ACCOUNT)_ID")).alias("cross_product_identity"),
        (F.col("execution_count") >= frequent).alias("high_frequency"),
    )


def keyword_usage(log: DataFrame, keywords: Sequence[str], as_of: str, days: int = 30, top: int = 50) -> DataFrame:
    """Queries whose text holds any change keyword, with their executions per type, database, schema and user."""
    text, place = F.lower("query_text"), ["query_type", "database_name", "schema_name", "user_name"]
    hit = F.lit(False)
    for word in keywords:
        hit = hit | text.contains(word.lower())
    return (
        log.filter(since("start_time", as_of, days) & hit)
        .groupBy("query_text", *place)
        .agg(F.count(F.lit(1)).alias("execution_count"))
        .orderBy(F.desc("execution_count"), "query_text", *place)
        .limit(top)
    )
