"""Catalog knowledge model: crawl, profile, classify, enrich."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import null_safe_join, pick_bounded, rounded
from tidemark.functions.naming import column_role

TABLE_KEY = ["database_name", "schema_name", "table_name"]


def full_name() -> Column:
    return F.concat_ws(".", *TABLE_KEY)


def columns_of(columns: DataFrame) -> DataFrame:
    """Ordered column list per table; a table has a bounded number of columns."""
    item = F.struct("ordinal", F.col("column_name").alias("name"), F.col("data_type").alias("type"), "nullable", "comment")
    return columns.groupBy(*TABLE_KEY).agg(F.array_sort(F.collect_list(item)).alias("columns"))


def build_concepts(tables: DataFrame, columns: DataFrame, constraints: DataFrame, as_of: str) -> DataFrame:
    """One row per database, schema and table; tables carry their columns and constraints."""
    stamp = F.lit(as_of).cast("timestamp_ntz").alias("crawled_at")
    links = constraints.groupBy(*TABLE_KEY).agg(
        F.array_sort(F.collect_list(F.struct("constraint_name", "constraint_type", "column_name", "ref_table", "ref_column"))).alias(
            "constraints"
        )
    )
    table_rows = (
        tables.join(columns_of(columns), TABLE_KEY, "left")
        .join(links, TABLE_KEY, "left")
        .select(
            F.lit("table").alias("concept_level"), *TABLE_KEY, full_name().alias("full_name"), "row_count", "bytes", "owner",
            "comment", "columns", "constraints", stamp,
        )
    )
    schema_rows = tables.groupBy("database_name", "schema_name").agg(
        F.sum("row_count").alias("row_count"), F.sum("bytes").alias("bytes")
    ).select(
        F.lit("schema").alias("concept_level"), "database_name", "schema_name",
        F.concat_ws(".", "database_name", "schema_name").alias("full_name"), "row_count", "bytes", stamp,
    )
    database_rows = tables.groupBy("database_name").agg(
        F.sum("row_count").alias("row_count"), F.sum("bytes").alias("bytes")
    ).select(
        F.lit("database").alias("concept_level"), "database_name", F.col("database_name").alias("full_name"), "row_count",
        "bytes", stamp,
    )
    return table_rows.unionByName(schema_rows, allowMissingColumns=True).unionByName(
        database_rows, allowMissingColumns=True
    )


def schema_hash(columns: str | Column = "columns") -> Column:
    """Hash of an ordered column list; the only test for schema drift."""
    c = F.col(columns) if isinstance(columns, str) else columns
    line = F.transform(c, lambda x: F.concat_ws("|", x["ordinal"].cast("string"), x["name"], x["type"], x["nullable"].cast("string")))
    return F.sha2(F.array_join(line, ";"), 256)


def hashed(columns: DataFrame) -> DataFrame:
    """Schema hash and number of columns per table."""
    return columns_of(columns).select(
        *TABLE_KEY, schema_hash().alias("schema_hash"), F.size("columns").cast("bigint").alias("column_count")
    )


def delta_upsert(target: DataFrame, snapshot: DataFrame, mode: str = "DELTA", key: list[str] | None = None) -> DataFrame:
    """Merge a snapshot into a target by key and hash.

    FULL replaces everything. DELTA inserts unseen keys, updates rows with
    another hash, and leaves the rest untouched; the `action` says which.
    """
    key = key or TABLE_KEY
    if mode.upper() == "FULL":
        return snapshot.select(*key, "schema_hash", F.lit("insert").alias("action"))
    old = target.select(*key, F.col("schema_hash").alias("_old"), F.lit(True).alias("_known"))
    new = snapshot.select(*[F.col(k).alias(f"_n_{k}") for k in key], F.col("schema_hash").alias("_new"), F.lit(True).alias("_seen"))
    cond = None
    for k in key:
        term = F.col(k).eqNullSafe(F.col(f"_n_{k}"))
        cond = term if cond is None else cond & term
    both = old.join(new, cond, "full_outer")
    action = (
        F.when(F.col("_known").isNull(), "insert")
        .when(F.col("_seen").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new")), "update")
        .otherwise("keep")
    )
    return both.select(
        *[F.coalesce(F.col(k), F.col(f"_n_{k}")).alias(k) for k in key],
        F.coalesce("_new", "_old").alias("schema_hash"),
        action.alias("action"),
    )


def catalog_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New, altered and dropped tables between two hashed snapshots."""
    a = old.select(*TABLE_KEY, F.col("schema_hash").alias("old_hash"))
    b = new.select(*TABLE_KEY, F.col("schema_hash").alias("new_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), "NEW")
        .when(F.col("new_hash").isNull(), "DROPPED")
        .when(F.col("old_hash") != F.col("new_hash"), "ALTERED")
    )
    return a.join(b, TABLE_KEY, "full_outer").withColumn("change", change).filter(F.col("change").isNotNull())


def string_values(table: DataFrame) -> DataFrame:
    """One row per string column and value of a table, read in one pass."""
    names = [f.name for f in table.schema.fields if f.dataType.simpleString() == "string"]
    return table.select(*names).unpivot([], names, "column_name", "value").filter(F.col("value").isNotNull())


def profile_values(table: DataFrame, n: int = 20) -> DataFrame:
    """First n distinct values, in order, of each string column."""
    return pick_bounded(string_values(table).distinct(), ["column_name"], [F.col("value")], n).select(
        "column_name", F.col("_rn").cast("bigint").alias("position"), "value"
    )


def detect_enum(table: DataFrame, limit: int = 25) -> DataFrame:
    """String columns with fewer than `limit` distinct values.

    A sketch of one row per column drops the columns that surely have more; the
    exact count then never shuffles a high-cardinality column.
    """
    names = [f.name for f in table.schema.fields if f.dataType.simpleString() == "string"]
    sketch = (
        table.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in names])
        .unpivot([], names, "column_name", "approx")
        .filter(F.col("approx") < limit * 2)
    )
    few = string_values(table).join(F.broadcast(sketch.select("column_name")), "column_name", "left_semi")
    return (
        few.distinct()
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("distinct_values"))
        .filter(F.col("distinct_values") < limit)
    )


def table_payload(raw: DataFrame, property_texts: DataFrame | None = None) -> DataFrame:
    """Structured description of each table: full name, text, columns with type and role."""
    described = raw.withColumn("_c", F.explode("columns"))
    item = F.col("_c")
    if property_texts is not None:
        texts = property_texts.select(F.upper("name").alias("_p"), F.col("description").alias("_d"))
        described = described.join(texts, F.upper(item["name"]) == F.col("_p"), "left")
    else:
        described = described.withColumn("_d", F.lit(None).cast("string"))
    entry = F.struct(
        item["ordinal"].alias("ordinal"), item["name"].alias("name"), F.coalesce(item["type"], F.lit("VARCHAR")).alias("type"),
        column_role(item["name"]).alias("role"), F.col("_d").alias("description"),
    )
    return described.groupBy("full_name", "comment").agg(F.array_sort(F.collect_list(entry)).alias("columns"))


def search_text(raw: DataFrame, description: Column) -> DataFrame:
    """Text a search reads: name parts, description and column names."""
    names = F.array_join(F.transform("columns", lambda c: c["name"]), " ")
    return raw.select(
        "full_name", F.concat_ws(" ", "table_name", "schema_name", "database_name", description, names).alias("search_text")
    )


def rich_search_text(concepts: DataFrame, columns: DataFrame) -> DataFrame:
    """Longer search text with keywords and column comments."""
    lists = columns_of(columns)
    names = F.array_join(F.transform("columns", lambda c: c["name"]), " ")
    notes = F.array_join(F.array_compact(F.transform("columns", lambda c: c["comment"])), " ")
    return concepts.join(lists, TABLE_KEY).select(
        "full_name",
        F.concat_ws(" ", "table_name", "description", F.array_join("keywords", " "), names, F.nullif(notes, F.lit(""))).alias(
            "search_text"
        ),
    )


def enrich_free(raw: DataFrame, concepts: DataFrame) -> DataFrame:
    """Free enrichment of tables that are new or were crawled again since their enrichment."""
    known = concepts.select("full_name", F.col("enriched_at").alias("_e"))
    due = raw.join(known, "full_name", "left").filter(F.col("_e").isNull() | (F.col("crawled_at") > F.col("_e")))
    noted = F.coalesce(F.col("comment"), F.lit("")) != ""
    return due.select(
        "full_name",
        F.when(noted, F.col("comment")).otherwise(F.concat(F.lit("Table "), F.col("table_name"))).alias("description"),
        F.when(noted, F.lit(0.40)).otherwise(F.lit(0.25)).alias("quality_score"),
        F.lit("HEURISTIC").alias("enrichment_source"),
        F.when(F.col("_e").isNull(), "insert").otherwise("update").alias("action"),
    )


def enrich_from_ontology(raw: DataFrame, classes: DataFrame, concepts: DataFrame) -> DataFrame:
    """Descriptions taken over from ontology classes, matched by table name."""
    c = classes.filter(F.col("source_table").isNotNull() & F.col("description").isNotNull()).select(
        F.upper("source_table").alias("_t"), F.col("description").alias("class_description"), "class_name"
    )
    known = concepts.select("full_name").distinct().withColumn("_k", F.lit(True))
    return (
        raw.join(c, F.upper("table_name") == F.col("_t"))
        .join(known, "full_name", "left")
        .select(
            "full_name", "class_name", F.col("class_description").alias("description"), F.lit(0.90).alias("quality_score"),
            F.lit(0).cast("bigint").alias("tier"), F.when(F.col("_k"), "update").otherwise("insert").alias("action"),
        )
    )


# Score below which a paid tier looks at a concept, batch limit of the tier, score it sets.
PAID_TIERS = {1: (0.5, 25, 0.60), 2: (0.6, 20, 0.75), 3: (0.75, 10, 0.85)}


def enrichment_queue(concepts: DataFrame, tier: int, batch: int = 20) -> DataFrame:
    """Next concepts for a paid tier, most used first, cut into batches."""
    below, limit, _ = PAID_TIERS[tier]
    first = (
        concepts.filter(F.col("is_active") & (F.col("quality_score") < below))
        .orderBy(F.desc("usage_count"), "full_name")
        .limit(limit)
    )
    # the ranked set has at most `limit` rows
    ranked = pick_bounded(first.withColumn("_all", F.lit(1)), ["_all"], [F.desc("usage_count"), F.col("full_name")], limit)
    return ranked.select(
        "full_name", "quality_score", "usage_count", F.col("_rn").cast("bigint").alias("position"),
        (F.floor((F.col("_rn") - 1) / batch) + 1).alias("batch"),
    )


def apply_enrichment(concepts: DataFrame, results: DataFrame, tier: int) -> DataFrame:
    """Concepts after the supplied results of a paid tier."""
    r = results.select("full_name", F.col("description").alias("_d"))
    _, _, score = PAID_TIERS[tier]
    return concepts.join(r, "full_name", "left").select(
        "full_name",
        F.coalesce("_d", "description").alias("description"),
        F.when(F.col("_d").isNotNull(), F.lit(score)).otherwise(F.col("quality_score")).alias("quality_score"),
        F.when(F.col("_d").isNotNull(), F.lit(tier)).otherwise(F.col("tier")).cast("bigint").alias("tier"),
    )


def quality_score(concepts: DataFrame, has_tables: Column) -> DataFrame:
    """Completeness of each concept as a sum of six parts."""

    def part(condition: Column, points: float) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.lit(points)).otherwise(F.lit(0.0))

    score = (
        part(F.length("description") > 20, 0.30)
        + part(F.size("keywords") >= 3, 0.15)
        + part(has_tables, 0.20)
        + part(F.col("has_joins"), 0.15)
        + part(F.col("has_metrics"), 0.10)
        + part(F.col("has_samples"), 0.10)
    )
    return concepts.select("full_name", rounded(score, 2).alias("quality_score"))


OBVIOUS_COLUMN = r"_(ID|KEY|DATE|TIME|AMOUNT|TOTAL|NAME|TYPE|STATUS|FLAG)$"


def enrichment_cost(raw: DataFrame) -> DataFrame:
    """Credits that enriching would take, per tier and in total."""
    bare = F.coalesce(F.col("comment"), F.lit("")) == ""
    unclear = F.size(F.filter("columns", lambda c: ~c["name"].rlike(OBVIOUS_COLUMN)))
    return raw.agg(
        F.count_if(~bare).alias("tier_0_free"),
        F.coalesce(F.sum(F.when(bare, unclear)), F.lit(0)).alias("_c"),
        F.count_if(bare).alias("_u"),
        F.count_if(F.exists("columns", lambda c: c["type"] == "VARIANT")).alias("_v"),
    ).select(
        "tier_0_free",
        rounded(F.col("_c") * 0.001, 4).alias("tier_1_est_credits"),
        rounded(F.col("_u") * 0.01, 4).alias("tier_2_est_credits"),
        rounded(F.col("_v") * 0.05, 4).alias("tier_3_est_credits"),
        rounded(F.col("_c") * 0.001 + F.col("_u") * 0.01 + F.col("_v") * 0.05, 4).alias("total_est_credits"),
    )


def spend_by_day(log: DataFrame) -> DataFrame:
    """Calls and credits per day and tier."""
    return log.groupBy(F.to_date("ts").alias("day"), "tier").agg(
        F.count(F.lit(1)).alias("calls"), rounded(F.sum(F.col("credits").cast("decimal(20,6)")).cast("double"), 6).alias("credits")
    )


def spend_status(log: DataFrame, day: str, budget: float, warn_at: float = 0.8) -> DataFrame:
    """Credits of one day against the daily budget."""
    spent = F.coalesce(F.sum(F.col("credits").cast("decimal(20,6)")).cast("double"), F.lit(0.0))
    return log.filter(F.to_date("ts") == F.lit(day).cast("date")).agg(rounded(spent, 6).alias("total_today")).select(
        "total_today",
        F.lit(budget).alias("budget"),
        rounded(F.try_divide(F.col("total_today") * 100, F.lit(budget)), 2).alias("pct_used"),
        F.when(F.col("total_today") >= budget * warn_at, "WARNING").otherwise("OK").alias("status"),
    )


def upsert_config(config: DataFrame, overrides: DataFrame, known_domains: DataFrame) -> DataFrame:
    """Settings after overriding them by key; settings of unknown domains are reported as errors."""
    merged = null_safe_join(
        config.select("domain", "key", F.col("value").alias("_old")),
        overrides.select("domain", "key", F.col("value").alias("_new")),
        ["domain", "key"],
        "left",
    )
    added = overrides.join(config, ["domain", "key"], "left_anti").select(
        "domain", "key", F.lit(None).cast("string").alias("_old"), F.col("value").alias("_new")
    )
    known = known_domains.select("domain").distinct().withColumn("_k", F.lit(True))
    return (
        merged.select("domain", "key", "_old", "_new")
        .unionByName(added)
        .join(known, "domain", "left")
        .select(
            "domain", "key", F.coalesce("_new", "_old").alias("value"),
            F.when(F.col("_k").isNull(), "UNKNOWN_DOMAIN").when(F.col("_old").isNull(), "ADDED")
            .when(F.col("_new").isNull(), "KEPT").otherwise("UPDATED").alias("status"),
        )
    )


def config_summary(config: DataFrame, sources: DataFrame, tier_key: str = "enrichment_max_tier") -> DataFrame:
    """Source databases and tier of each domain, as `upsert_config` left its settings.

    `sources` holds domain and database_name. A domain without the setting has tier 0; settings of unknown domains do not count.
    """
    tier = F.max(F.when((F.col("key") == tier_key) & (F.col("status") != "UNKNOWN_DOMAIN"), F.col("value")))
    tiers = config.groupBy("domain").agg(tier.alias("_t"), F.count_if(F.col("status").isin("ADDED", "UPDATED")).alias("_n"))
    counts = sources.groupBy("domain").agg(F.count_distinct("database_name").alias("database_count"))
    return counts.join(tiers, "domain", "left").select(
        "domain", "database_count", F.coalesce("_t", F.lit("0")).alias("tier"), F.coalesce("_n", F.lit(0)).alias("changed_settings")
    )


def union_domains(per_domain: dict[str, DataFrame | None]) -> DataFrame:
    """Active concepts of all domains in one relation; a missing domain is skipped."""
    out = None
    for name, df in sorted(per_domain.items()):
        if df is None:
            continue
        rows = df.filter("is_active").withColumn("source_domain", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no domain has concepts")
    return out
