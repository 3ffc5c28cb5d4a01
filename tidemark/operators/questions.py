"""What the log of asked questions says about concepts, domains and readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import as_large, broadcast_if_small, pick_bounded, rounded, text_list
from tidemark.functions.naming import column_class, describe_column
from tidemark.operators.usage import since


def share(condition: Column) -> Column:
    """Share of rows for which a condition holds, over the rows where it is known."""
    return rounded(F.try_divide(F.count_if(condition).cast("double"), F.count(condition)), 4)


def promotion_candidates(
    questions: DataFrame, as_of: str, days: int = 30, min_count: int = 5, min_rate: float = 0.0, samples: int = 3
) -> DataFrame:
    """Sets of concepts asked often enough, and well enough answered, to be promoted.

    The success rate counts every attempt, failed ones too.
    """
    recent = questions.filter(since("asked_at", as_of, days)).withColumn(
        "concepts", F.array_join(F.array_sort("concepts_used"), ",")
    )
    sets = recent.groupBy("concepts").agg(
        F.count(F.lit(1)).alias("query_count"), share(F.col("status") == "OK").alias("success_rate")
    ).filter((F.col("query_count") >= min_count) & (F.col("success_rate") >= min_rate))
    asked = pick_bounded(recent.select("concepts", "question").distinct(), ["concepts"], [F.col("question")], samples)
    texts = asked.groupBy("concepts").agg(text_list(F.sha2("question", 256)).alias("sample_questions"))
    return sets.join(texts, "concepts")


def used_concepts(questions: DataFrame, as_of: str, days: int) -> DataFrame:
    """One row per question and concept that answered it."""
    return questions.filter(since("asked_at", as_of, days)).select(
        "question_id", "status", "helpful", F.explode(F.array_distinct("concepts_used")).alias("concept_id")
    )


def concept_usage(concepts: DataFrame, questions: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Uses, success rate and helpfulness of each concept."""
    return (
        used_concepts(questions, as_of, days)
        .groupBy("concept_id")
        .agg(
            F.count(F.lit(1)).alias("usage_count"),
            share(F.col("status") == "OK").alias("success_rate"),
            share(F.col("helpful")).alias("helpfulness_rate"),
        )
        .join(concepts.select("concept_id", "full_name"), "concept_id")
    )


def low_performers(usage: DataFrame, min_uses: int = 5, below: float = 0.5) -> DataFrame:
    """Concepts used often but rarely with success."""
    return usage.filter((F.col("usage_count") >= min_uses) & (F.col("success_rate") < below))


def failing_questions(questions: DataFrame, as_of: str, days: int = 30, top: int = 20) -> DataFrame:
    """Questions that failed or found nothing, most frequent first."""
    return (
        questions.filter(since("asked_at", as_of, days) & F.col("status").isin("ERROR", "EMPTY"))
        .groupBy("question", "status", "error_message")
        .agg(F.count(F.lit(1)).alias("occurrence_count"))
        .orderBy(F.desc("occurrence_count"), "question", "status", F.asc_nulls_first("error_message"))
        .limit(top)
    )


def quality_vs_success(concepts: DataFrame, questions: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Questions and success rate per quality score of the concepts behind them.

    A question counts once per score, so the questions are made distinct before
    they are counted.
    """
    return (
        used_concepts(questions, as_of, days)
        .join(concepts.select("concept_id", "quality_score"), "concept_id")
        .select("quality_score", "question_id", "status")
        .distinct()
        .groupBy("quality_score")
        .agg(F.count(F.lit(1)).alias("queries"), share(F.col("status") == "OK").alias("success_rate"))
    )


def unused_concepts(concepts: DataFrame, questions: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Active concepts that no question of the window used."""
    used = used_concepts(questions, as_of, days).select("concept_id")
    return concepts.filter("is_active").join(used, "concept_id", "left_anti").select("concept_id", "full_name", "enriched_at")


def health_summary(concepts: DataFrame, states: DataFrame) -> DataFrame:
    """Metric and value rows on the state of a domain; `detail` holds the time of the last refresh, over all concepts."""
    c = concepts.filter("is_active").agg(
        F.count(F.lit(1)).cast("double").alias("total_concepts"),
        rounded(F.sum(F.col("quality_score").cast("decimal(18,4)")).cast("double") / F.count(F.lit(1)), 2).alias("avg_quality_score"),
        F.count_if(F.col("quality_score") < 0.5).cast("double").alias("concepts_needing_re_enrich"),
    )
    s = states.agg(
        F.count_if(F.col("object_state").startswith("SHADOW")).cast("double").alias("shadow_objects"),
        F.count_if(F.col("object_state") == "KNOWN_DRIFTED").cast("double").alias("drifted_objects"),
    )
    figures = c.unpivot([], c.columns, "metric", "value").unionByName(s.unpivot([], s.columns, "metric", "value"))
    last = concepts.agg(F.date_format(F.max("enriched_at"), "yyyy-MM-dd HH:mm:ss").alias("detail"))
    return figures.withColumn("detail", F.lit(None).cast("string")).unionByName(
        last.select(F.lit("last_refresh").alias("metric"), F.lit(None).cast("double").alias("value"), "detail")
    )


def scoped_concepts(
    concepts: DataFrame, role_map: DataFrame, role: str, admins: Sequence[str] = ("SYSADMIN", "ACCOUNTADMIN")
) -> DataFrame:
    """Concepts a role may see: everything for administrators, else its mapped domains."""
    if role.upper() in admins:
        return concepts
    allowed = role_map.filter(F.upper("role_name") == role.upper()).select("domain").distinct()
    return concepts.join(allowed, "domain", "left_semi")


def graduation_ready(concepts: DataFrame, relations: DataFrame, min_tables: int = 3, min_relations: int = 2) -> DataFrame:
    """Domains with enough tables and relations to become an ontology."""
    active = concepts.filter("is_active")
    tables = active.groupBy("domain").agg(
        F.count_distinct("full_name").alias("table_count"), F.sum("usage_count").alias("total_queries")
    )
    links = (
        relations.join(as_large(active.select("full_name", "domain")), F.col("source_table") == F.col("full_name"))
        .groupBy("domain")
        .agg(F.count_distinct("source_table").alias("relation_count"))
    )
    return tables.join(links, "domain").filter(
        (F.col("table_count") >= min_tables) & (F.col("relation_count") >= min_relations)
    )


def top_tables(concepts: DataFrame, top: int = 20) -> DataFrame:
    """Most used tables of each domain."""
    return pick_bounded(concepts.filter("is_active"), ["domain"], [F.desc("usage_count"), F.col("full_name")], top).select(
        "domain", "full_name", "usage_count", F.col("_rn").cast("bigint").alias("position")
    )


def top_keywords(concepts: DataFrame, top: int = 15) -> DataFrame:
    """Most frequent keywords of each domain."""
    counted = concepts.select("domain", F.explode("keywords").alias("keyword")).groupBy("domain", "keyword").agg(
        F.count(F.lit(1)).alias("freq")
    )
    return pick_bounded(counted, ["domain"], [F.desc("freq"), F.col("keyword")], top).select("domain", "keyword", "freq")


def conflict_summary(concepts: DataFrame, relations: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Active concepts, relations and open conflicts by severity per domain."""
    active = concepts.filter("is_active")
    c = active.groupBy("domain").agg(F.count(F.lit(1)).alias("active_concepts"))
    r = (
        relations.join(as_large(active.select("full_name", "domain")), F.col("source_table") == F.col("full_name"))
        .groupBy("domain")
        .agg(F.count(F.lit(1)).alias("active_relationships"))
    )
    o = conflicts.filter("resolution_status = 'OPEN'").groupBy("domain").agg(
        F.count(F.lit(1)).alias("open_conflicts"),
        F.count_if(F.col("severity") == "HIGH").alias("high_conflicts"),
    )
    counts = ["active_relationships", "open_conflicts", "high_conflicts"]
    return c.join(r, "domain", "left").join(o, "domain", "left").fillna(0, counts)


def verify_metrics(definitions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Metric definitions set against the decision taken on each."""
    d = decisions.select("metric_name", F.col("chosen_expr").alias("_c"))
    return definitions.join(d, "metric_name", "left").select(
        "metric_name",
        "expr",
        F.when(F.col("_c").isNull(), "UNDECIDED").when(F.col("_c") == F.col("expr"), "CONFIRMED").otherwise("CONFLICT").alias("status"),
    )


def spec_name(domain: str, prefix: str = "sv") -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.regexp_replace(F.regexp_replace(F.lower(domain), " ", "_"), "&", "and"))


def spec_metrics(columns: DataFrame, metrics: DataFrame, prefix: str = "sv") -> DataFrame:
    """Metrics of each logical table: those of its domain whose name holds the name of the table.

    Names are met by equality with the pieces of a metric's name that are as long as some table's name, not by trying all
    tables of a domain. `metrics` holds domain, metric_name and expr, and may hold sample_questions.
    """
    tables = columns.select("domain", F.concat_ws(".", "database_name", "schema_name", "table_name").alias("base_table"), F.lower("table_name").alias("logical_table")).distinct()
    sizes = tables.agg(F.collect_set(F.length("logical_table")).alias("s")).scalar()  # as many as a name has letters at most
    name = F.lower("metric_name")
    asked = F.col("sample_questions") if "sample_questions" in metrics.columns else F.lit(None).cast("string")
    known = metrics.select("domain", "metric_name", "expr", asked.alias("description")).distinct()
    fits = F.filter("_s", lambda n: n <= F.length(name))
    at = lambda n: F.sequence(F.lit(1), F.length(name) - n + 1)
    pieces = F.array_distinct(F.flatten(F.transform(fits, lambda n: F.transform(at(n), lambda i: F.substring(name, i, n)))))  # each once within a name
    return (
        known.withColumn("_s", sizes).select("domain", "metric_name", "expr", "description", F.explode(pieces).alias("logical_table"))
        .join(as_large(tables), ["domain", "logical_table"])
        .select(spec_name("domain", prefix).alias("name"), "base_table", "logical_table", "metric_name", "expr", "description")
    )


def spec_relations(columns: DataFrame, relations: DataFrame, prefix: str = "sv") -> DataFrame:
    """Relations of each domain's specification, one row each; a domain holds those of its databases."""
    named = columns.select("domain", "database_name").distinct().select(spec_name("domain", prefix).alias("_spec"), "database_name")
    owned = broadcast_if_small(named)  # a row a database, named once; the pairs stay where they are
    return relations.join(owned, "database_name").select(
        F.col("_spec").alias("name"), F.col("name").alias("relation"), "database_name", "left_table", "right_table", "relationship_columns"
    )


def spec_verified(columns: DataFrame, verified: DataFrame, prefix: str = "sv") -> DataFrame:
    """Verified queries of each domain that has tables, one row each."""
    return verified.join(columns.select("domain").distinct(), "domain", "left_semi").select(
        spec_name("domain", prefix).alias("name"), F.col("name").alias("query_name"), "question", "sql", "use_as_onboarding_question"
    )


def semantic_spec(columns: DataFrame, relations: DataFrame, verified: DataFrame, prefix: str = "sv") -> DataFrame:
    """Logical tables of each domain with their dimensions, time dimensions and facts.

    One row per table, so that no domain has to fit into one cell; `columns`
    carries the domain. `relations` holds one row per relation, or numbers of
    them in `pairs`. Lists that would be empty are left out as null.
    """
    kind = column_class(F.col("column_name"), F.col("data_type"))

    def listed(which: str) -> Column:
        item = F.when(kind == which, F.struct("ordinal", F.lower("column_name").alias("n"), describe_column(F.col("column_name")).alias("d")))
        text = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(x["n"], F.lit(": "), x["d"]))
        return F.nullif(F.array_join(text, "; "), F.lit(""))

    tables = columns.groupBy("domain", "database_name", "schema_name", "table_name").agg(
        listed("dimension").alias("dimensions"), listed("time_dimension").alias("time_dimensions"), listed("fact").alias("facts")
    )
    pairs = F.sum("pairs") if "pairs" in relations.columns else F.count(F.lit(1))
    links = relations.groupBy("database_name", F.col("left_table").alias("_lt")).agg(pairs.alias("relationships"))
    asked = verified.groupBy("domain").agg(F.count(F.lit(1)).alias("verified_queries"))
    return (
        tables.join(
            as_large(links.withColumnRenamed("database_name", "_ldb")),
            (F.col("database_name") == F.col("_ldb")) & (F.lower("table_name") == F.col("_lt")),
            "left",
        )
        .join(asked, "domain", "left")
        .select(
            spec_name("domain", prefix).alias("name"),
            F.concat_ws(".", "database_name", "schema_name", "table_name").alias("base_table"),
            F.lower("table_name").alias("logical_table"),
            "dimensions",
            "time_dimensions",
            "facts",
            F.coalesce("relationships", F.lit(0)).alias("relationships"),
            F.coalesce("verified_queries", F.lit(0)).alias("verified_queries"),
        )
    )


def regression_checks(registry: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Named check rows: each domain exists, and where its tables are expected."""
    counts = registry.groupBy(F.col("domain").alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    wanted = registry.sparkSession.createDataFrame([(d,) for d in domains], "domain string")
    n = F.coalesce("_n", F.lit(0))
    found = wanted.join(counts, F.col("domain") == F.col("_d"), "left")
    exists = found.select(
        "domain", F.lit("domain_exists").alias("test_name"), F.when(n > 0, "PASS").otherwise("FAIL").alias("status"),
        F.concat(F.lit("count="), n.cast("string")).alias("detail"),
    )
    tables = found.select(
        "domain", F.lit("query_plane_tables_present").alias("test_name"), F.lit("INFO").alias("status"),
        F.concat(F.lit("meta_db="), F.col("domain"), F.lit("_META")).alias("detail"),
    )
    return exists.unionByName(tables)
