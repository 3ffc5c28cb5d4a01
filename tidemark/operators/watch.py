"""Watching a catalog: object states, similarity to known classes, drift, triage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import as_large, rounded
from tidemark.session import durable

from tidemark.operators.catalog import TABLE_KEY, full_name
from tidemark.operators.usage import flatten_access, since


def watch_states(
    concepts: DataFrame, current: DataFrame, access: DataFrame, as_of: str, days: int = 30, poor_below: float = 0.3
) -> DataFrame:
    """State and next action of every object that is known, or exists, or both.

    When several states apply to a known object, deleted comes before poor,
    drifted and current. Without any object one row says that all is up to date.
    """
    known = concepts.filter("is_active").select(
        F.upper("full_name").alias("_name"), F.col("full_name").alias("_known"), "quality_score", "enriched_at"
    )
    live = current.select(full_name().alias("_live"), F.upper(full_name()).alias("_name"), F.col("last_altered").alias("_altered"))
    used = (
        flatten_access(access.filter(since("ts", as_of, days)))
        .filter(F.col("object_domain") == "Table")
        .groupBy(F.upper("object_name").alias("_name"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    both = known.join(live, "_name", "full_outer").join(used, "_name", "left")
    missing, shadow = F.col("_live").isNull(), F.col("_known").isNull()
    state = (
        F.when(shadow & (F.coalesce("_n", F.lit(0)) > 0), "SHADOW_ACTIVE")
        .when(shadow, "SHADOW_INACTIVE")
        .when(missing, "KNOWN_DELETED")
        .when(F.col("quality_score") < poor_below, "ONBOARDED_INCORRECTLY")
        .when(F.col("_altered") > F.col("enriched_at"), "KNOWN_DRIFTED")
        .otherwise("KNOWN_CURRENT")
    )
    s = F.col("object_state")
    found = both.select(F.coalesce("_known", "_live").alias("object_fqn"), state.alias("object_state"), F.coalesce("_n", F.lit(0)).alias("access_count"))
    spark = concepts.sparkSession
    nothing = spark.range(1).filter(found.select(F.count(F.lit(1))).scalar() == 0).select(
        F.lit("").alias("object_fqn"), F.lit("KNOWN_CURRENT").alias("object_state"), F.lit(0).cast("bigint").alias("access_count")
    )
    action = (
        F.when(s.isin("KNOWN_DRIFTED", "ONBOARDED_INCORRECTLY"), "re-enrich")
        .when(s == "SHADOW_ACTIVE", "onboard")
        .when(s == "SHADOW_INACTIVE", "defer")
        .otherwise("ignore")
    )
    return found.unionByName(nothing).withColumn("triage_action", action)


# Fixed value: tables and classes of a column up to which it counts as rare.
RARE_COLUMN = 64


def match_class(shadow_columns: DataFrame, class_columns: DataFrame, min_similarity: float = 0.7) -> DataFrame:
    """Best class per table by the Jaccard similarity of the column names.

    Both inputs hold (name, column_name). Two sets at least t alike share one of
    the |s| - ceil(t|s|) + 1 rarest columns of either side, so only those meet in
    the join; a column that every table has produces no candidates. Nor do sets
    of too different size. Each side is derived once and written.

    Sets that share a rare column meet one by one. Of sets that share none, the
    size and the frequent columns decide alone, so all with the same ones are one
    row, classes with the least name; where two do share a rare one, this only
    understates them, and they have met in full already.
    """
    rarity = (
        shadow_columns.select("column_name").unionAll(class_columns.select("column_name"))
        .groupBy(F.upper("column_name").alias("_c"))
        .agg(F.count(F.lit(1)).alias("_f"))
    )

    def sets(df: DataFrame, name: str) -> DataFrame:
        listed = (
            df.filter(F.col("name").isNotNull()).select(F.col("name").alias(name), F.upper("column_name").alias("_c"))
            .distinct()
            .join(as_large(rarity), "_c")
            .groupBy(name)
            .agg(F.array_sort(F.collect_list(F.struct("_f", "_c"))).alias("_all"))
        )
        n = F.size("_all")
        names = lambda items: F.transform(items, lambda x: x["_c"])
        first = F.slice("_all", F.lit(1), n - F.ceil(n * F.lit(min_similarity) - 1e-9).cast("int") + 1)
        rare = lambda x: x["_f"] <= RARE_COLUMN
        often = lambda x: x["_f"] > RARE_COLUMN
        return durable(
            listed.select(
                name, n.alias("_n"), names("_all").alias("_set"), names(F.filter("_all", often)).alias("_often"),
                names(F.filter(first, rare)).alias("_rare_first"), names(F.filter(first, often)).alias("_often_first"),
            )
        )

    a, b = sets(shadow_columns, "table_name"), sets(class_columns, "class_name")
    alike = F.least("_na", "_nb") >= F.greatest("_na", "_nb") * F.lit(min_similarity) - 1e-9

    def scored(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of `left` (_a, _na, _sa, _pa) and `right` (_b, _nb, _sb, _pb) that are alike enough, each once: at the first column they share."""
        met = left.withColumn("_c", F.explode("_pa")).join(as_large(right.withColumn("_c", F.explode("_pb"))), "_c").filter(alike)
        both = F.array_intersect("_sa", "_sb")
        j = F.size("_both") / (F.col("_na") + F.col("_nb") - F.size("_both"))
        once = met.withColumn("_both", both).filter(F.get("_both", F.lit(0)) == F.col("_c"))
        return once.select("_a", "_b", j.alias("_j")).filter(F.col("_j") >= min_similarity)

    def part(df: DataFrame, side: str, key: Column, whole: str, first: str) -> DataFrame:
        return df.select(key.alias(f"_{side}"), F.col("_n").alias(f"_n{side}"), F.col(whole).alias(f"_s{side}"), F.col(first).alias(f"_p{side}"))

    rare = scored(part(a, "a", F.col("table_name"), "_set", "_rare_first"), part(b, "b", F.col("class_name"), "_set", "_rare_first"))
    kind = ["_n", "_often", "_often_first"]
    shapes = a.select(*kind).distinct().withColumn("_id", F.struct(*kind))
    named = b.groupBy(*kind).agg(F.min("class_name").alias("class_name"))
    best = lambda df, key: df.groupBy(key).agg(F.max("_j").alias("_j"), F.min_by("_b", F.struct(-F.col("_j"), F.col("_b"))).alias("_b"))
    of_shape = best(scored(part(shapes, "a", F.col("_id"), "_often", "_often_first"), part(named, "b", F.col("class_name"), "_often", "_often_first")), "_a")
    frequent = a.select("table_name", F.struct(*kind).alias("_id")).join(as_large(of_shape), F.col("_id") == F.col("_a"))
    scored_rows = rare.select(F.col("_a").alias("table_name"), F.col("_b").alias("class_name"), "_j").unionByName(
        frequent.select("table_name", F.col("_b").alias("class_name"), "_j")
    )
    return scored_rows.groupBy("table_name").agg(
        F.min_by("class_name", F.struct(-F.col("_j"), F.col("class_name"))).alias("class_name"),
        rounded(F.max("_j"), 4).alias("similarity"),
        F.lit("ontology_review").alias("triage_action"),
    )


def ontology_drift(old: DataFrame, new: DataFrame, classes: DataFrame) -> DataFrame:
    """Tables of a class whose schema hash changed since the previous crawl."""
    mapped = classes.select(F.upper("source_table").alias("_name"), "class_name")
    before = old.select(F.upper(full_name()).alias("_name"), F.col("schema_hash").alias("old_hash"))
    after = new.select(full_name().alias("object_fqn"), F.upper(full_name()).alias("_name"), F.col("schema_hash").alias("new_hash"))
    return (
        mapped.join(before, "_name").join(after, "_name").filter(F.col("old_hash") != F.col("new_hash"))
        .select("object_fqn", "class_name", "old_hash", "new_hash", F.lit("ONTOLOGY_DRIFT").alias("object_state"))
    )


def new_namespaces(tables: DataFrame, known: DataFrame) -> DataFrame:
    """Databases, schemas and tables that the state table does not know."""
    out = None
    for level, key in (("database", TABLE_KEY[:1]), ("schema", TABLE_KEY[:2]), ("table", TABLE_KEY)):
        rows = (
            tables.select(*key).distinct().join(known.select(*key).distinct(), key, "left_anti")
            .select(F.lit(level).alias("level"), F.concat_ws(".", *key).alias("name"))
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def data_hash() -> Column:
    """Hash of name, row count and last change of a table."""
    stamp = F.coalesce(F.date_format("last_altered", "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    return F.md5(F.concat(full_name(), F.col("row_count").cast("string"), stamp))


def data_hash_drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Tables whose data hash differs from the stored one."""
    return (
        current.select(full_name().alias("object_fqn"), data_hash().alias("new_hash"))
        .join(stored.select("object_fqn", F.col("data_hash").alias("old_hash")), "object_fqn")
        .filter(F.col("old_hash") != F.col("new_hash"))
    )


def triage(
    objects: DataFrame,
    trusted_schemas: Sequence[str] = (),
    min_rows: int = 10,
    alert_queries: int = 100,
    alert_users: int = 5,
    moved_share: float = 0.5,
    poor_below: float = 0.3,
) -> DataFrame:
    """What to do with each object: ignore, alert, flag, onboard or nothing.

    Needs full_name, schema_name, table_name, is_known, is_transient, queries, users, row_count,
    previous_rows, column_count, previous_columns, quality_score.
    """
    name = F.upper("table_name")
    scratch = F.upper("schema_name").rlike("SCRATCH|TEMP") | name.rlike("_TEMP_|_TMP_|_STAGING_")
    ignore = scratch | (F.col("is_transient") & (F.col("queries") == 0)) | (F.col("row_count") < min_rows)
    alert = ~F.col("is_known") & ((F.col("queries") > alert_queries) | (F.col("users") > alert_users))
    moved = F.abs(F.col("row_count") - F.col("previous_rows")) > F.col("previous_rows") * moved_share
    flag = F.col("is_known") & (
        (F.col("column_count") != F.col("previous_columns")) | moved | (F.col("quality_score") < poor_below)
    )
    onboard = ~F.col("is_known") & F.upper("schema_name").isin(*[s.upper() for s in trusted_schemas])
    no = F.lit(False)
    decision = (
        F.when(F.coalesce(ignore, no), "AUTO_IGNORE")
        .when(F.coalesce(alert, no), "AUTO_ALERT")
        .when(F.coalesce(flag, no), "AUTO_FLAG")
        .when(F.coalesce(onboard, no), "AUTO_ONBOARD")
        .otherwise("NONE")
    )
    return objects.select("full_name", decision.alias("triage"))

