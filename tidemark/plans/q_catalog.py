"""Catalog knowledge queries: crawl, profile, classify, enrich."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import naming as N
from tidemark.operators import catalog as K
from tidemark.operators.usage import domain_of
from tidemark.plans.inputs import AS_OF
from tidemark.plans.registry import query

_AS_OF = f"TIMESTAMP '{AS_OF}'"
_FQN = "database_name || '.' || schema_name || '.' || table_name"


def raw_concepts(t):
    """Table-level raw concepts of the older snapshot."""
    return K.build_concepts(t.catalog_tables, t.catalog_columns, t.constraints, AS_OF).filter("concept_level = 'table'")


def hash_sql(name: str, source: str) -> str:
    return f"""{name} AS (SELECT database_name, schema_name, table_name, count(*) AS column_count,
      sha256(string_agg(concat_ws('|', CAST(ordinal AS VARCHAR), column_name, data_type, CAST(nullable AS VARCHAR)), ';' ORDER BY ordinal)) AS schema_hash
      FROM {source} GROUP BY 1, 2, 3)"""


@query(
    "build_concepts",
    f"""
    WITH c AS (SELECT database_name, schema_name, table_name,
                 string_agg(CAST(ordinal AS VARCHAR) || ':' || column_name || ':' || data_type, ',' ORDER BY ordinal) AS columns
               FROM catalog_columns GROUP BY 1, 2, 3),
    k AS (SELECT database_name, schema_name, table_name, string_agg(constraint_name, ',' ORDER BY constraint_name) AS constraints
          FROM constraints GROUP BY 1, 2, 3)
    SELECT 'table' AS concept_level, {_FQN.replace("database_name", "t.database_name").replace("schema_name", "t.schema_name").replace("table_name", "t.table_name")} AS full_name,
           t.row_count, t.bytes, c.columns, k.constraints
    FROM catalog_tables t LEFT JOIN c USING (database_name, schema_name, table_name)
    LEFT JOIN k USING (database_name, schema_name, table_name)
    UNION ALL
    SELECT 'schema', database_name || '.' || schema_name, CAST(sum(row_count) AS BIGINT), CAST(sum(bytes) AS BIGINT), NULL, NULL
    FROM catalog_tables GROUP BY database_name, schema_name
    UNION ALL
    SELECT 'database', database_name, CAST(sum(row_count) AS BIGINT), CAST(sum(bytes) AS BIGINT), NULL, NULL
    FROM catalog_tables GROUP BY database_name
    """,
    ("catalog_tables", "catalog_columns", "constraints"),
)
def _(t):
    names = F.transform("columns", lambda c: F.concat_ws(":", c["ordinal"].cast("string"), c["name"], c["type"]))
    return K.build_concepts(t.catalog_tables, t.catalog_columns, t.constraints, AS_OF).select(
        "concept_level", "full_name", "row_count", "bytes", F.array_join(names, ",").alias("columns"),
        F.array_join(F.transform("constraints", lambda c: c["constraint_name"]), ",").alias("constraints"),
    )


@query("schema_hash", f"WITH {hash_sql('h', 'catalog_columns')} SELECT * FROM h", ("catalog_columns",))
def _(t):
    return K.hashed(t.catalog_columns)


_BOTH = f"{hash_sql('o', 'catalog_columns')}, {hash_sql('n', 'catalog_columns_new')}"


@query(
    "delta_upsert",
    f"""
    WITH {_BOTH}
    SELECT database_name, schema_name, table_name, coalesce(n.schema_hash, o.schema_hash) AS schema_hash,
      CASE WHEN o.schema_hash IS NULL THEN 'insert' WHEN n.schema_hash IS NOT NULL AND n.schema_hash <> o.schema_hash
           THEN 'update' ELSE 'keep' END AS action
    FROM (SELECT * FROM o WHERE schema_name <> 'MART') o FULL JOIN n USING (database_name, schema_name, table_name)
    """,
    ("catalog_columns", "catalog_columns_new"),
)
def _(t):
    known = K.hashed(t.catalog_columns).filter("schema_name <> 'MART'")
    return K.delta_upsert(known, K.hashed(t.catalog_columns_new))


@query(
    "catalog_changes",
    f"""
    WITH {_BOTH}
    SELECT * FROM (
      SELECT database_name, schema_name, table_name, o.schema_hash AS old_hash, n.schema_hash AS new_hash,
        CASE WHEN o.schema_hash IS NULL THEN 'NEW' WHEN n.schema_hash IS NULL THEN 'DROPPED'
             WHEN o.schema_hash <> n.schema_hash THEN 'ALTERED' END AS change
      FROM o FULL JOIN n USING (database_name, schema_name, table_name)) WHERE change IS NOT NULL
    """,
    ("catalog_columns", "catalog_columns_new"),
)
def _(t):
    return K.catalog_changes(K.hashed(t.catalog_columns), K.hashed(t.catalog_columns_new))


def _values_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value FROM {table} WHERE {c} IS NOT NULL" for c in columns
    )


@query(
    "profile_values",
    f"""
    SELECT column_name, rn AS position, value FROM (
      SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value) AS rn
      FROM (SELECT DISTINCT * FROM ({_values_sql("part", ["p_name", "p_brand", "p_type"])}))) WHERE rn <= 20
    """,
)
def _(t):
    return K.profile_values(t.table("part"))


@query(
    "detect_enum",
    f"""
    SELECT column_name, count(DISTINCT value) AS distinct_values
    FROM ({_values_sql("customer", ["c_name", "c_mktsegment"])}
          UNION ALL {_values_sql("orders", ["o_orderstatus", "o_orderpriority"])})
    GROUP BY 1 HAVING count(DISTINCT value) < 25
    """,
)
def _(t):
    return K.detect_enum(t.table("customer")).unionByName(K.detect_enum(t.table("orders")))


@query(
    "column_role",
    """
    SELECT column_name, count(*) AS column_count,
      CASE WHEN regexp_matches(column_name, '_ID$') OR column_name = 'ID' THEN 'foreign_key'
           WHEN regexp_matches(column_name, '(_DATE|_AT|_TS|_TIME)$') THEN 'dimension'
           WHEN regexp_matches(column_name, '^(AMOUNT|TOTAL_|SUM_|COUNT_|REVENUE|PRICE)') THEN 'metric'
           WHEN regexp_matches(column_name, '(_AMOUNT|_TOTAL|_COUNT|_REVENUE|_PRICE)$') THEN 'metric'
           WHEN regexp_matches(column_name, '^(IS_|HAS_|FLAG_)') THEN 'dimension'
           WHEN column_name IN ('STATUS','TYPE','CATEGORY','CODE','STATE','TIER','LEVEL') THEN 'dimension'
           WHEN column_name IN ('NAME','DESCRIPTION','TITLE','LABEL') THEN 'dimension' ELSE 'attribute' END AS role
    FROM catalog_columns GROUP BY 1
    """,
    ("catalog_columns",),
)
def _(t):
    c = F.col("column_name")
    return t.catalog_columns.groupBy("column_name").agg(F.count(F.lit(1)).alias("column_count")).withColumn("role", N.column_role(c))


def _parts_case(name: str, parts: dict[str, list[str]], otherwise: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({name}, '{'|'.join(v)}') THEN '{k}'" for k, v in parts.items())
    return f"CASE {whens} ELSE '{otherwise}' END"


@query(
    "column_role_patterns",
    f"""
    SELECT column_name, count(*) AS column_count, {_parts_case("column_name", N.ROLE_PARTS, "attribute")} AS role
    FROM catalog_columns GROUP BY 1
    """,
    ("catalog_columns",),
)
def _(t):
    c = F.col("column_name")
    return t.catalog_columns.groupBy("column_name").agg(F.count(F.lit(1)).alias("column_count")).withColumn(
        "role", N.column_role_patterns(c)
    )


@query(
    "column_class",
    """
    SELECT column_name, data_type, count(*) AS column_count,
      CASE WHEN column_name LIKE '%\\_ID' ESCAPE '\\' OR column_name LIKE '%\\_KEY' ESCAPE '\\' OR column_name = 'ID' THEN 'key'
           WHEN data_type LIKE '%DATE%' OR data_type LIKE '%TIME%' THEN 'time_dimension'
           WHEN data_type IN ('NUMBER', 'FLOAT') THEN CASE
             WHEN regexp_matches(column_name, '_AMT|_AMOUNT|_QTY|_QUANTITY|_COUNT|_SUM|_TOTAL|_BALANCE|_PRICE|_COST|_REVENUE|_PCT|_RATE|_RATIO|_MARGIN') THEN 'fact'
             WHEN regexp_matches(column_name, '_IND$|^IS_|^HAS_') THEN 'dimension' ELSE 'fact' END
           ELSE 'dimension' END AS class
    FROM catalog_columns GROUP BY 1, 2
    """,
    ("catalog_columns",),
)
def _(t):
    return t.catalog_columns.groupBy("column_name", "data_type").agg(F.count(F.lit(1)).alias("column_count")).withColumn(
        "class", N.column_class(F.col("column_name"), F.col("data_type"))
    )


@query(
    "table_type",
    f"""
    SELECT {_FQN} AS full_name, {_parts_case("table_name", N.TABLE_PARTS, "other")} AS kind,
           regexp_matches(table_name, '(^|_)(TMP|TEMP|STG|STAGING|RAW|LOAD|BKP|BACKUP|OLD)(_|$|\\d)') AS staging_like
    FROM catalog_tables
    """,
    ("catalog_tables",),
)
def _(t):
    n = F.col("table_name")
    return t.catalog_tables.select(
        K.full_name().alias("full_name"), N.table_type(n).alias("kind"), N.is_staging_like(n).alias("staging_like")
    )


def _title(x: str) -> str:
    """Words of an upper-case name with initial capitals."""
    return (
        f"array_to_string(list_transform(string_split(replace({x}, '_', ' '), ' '), "
        "lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
    )


DESCRIBE_SQL = f"""
  CASE WHEN ends_with(c, '_ID') THEN CASE WHEN contains(c, 'ACCT') THEN 'Account identifier - join to dim_acct'
         WHEN contains(c, 'TITLE') THEN 'Title identifier - join to dim_title'
         WHEN contains(c, 'DEVICE') THEN 'Device identifier - join to dim_device'
         WHEN contains(c, 'PRODUCT') THEN 'Product identifier - join to dim_product'
         WHEN contains(c, 'COUNTRY') THEN 'Country identifier - join to dim_country'
         WHEN contains(c, 'REGION') THEN 'Region identifier - join to dim_region'
         WHEN contains(c, 'SKU') THEN 'SKU identifier - join to dim_product_sku'
         WHEN contains(c, 'DT') OR contains(c, 'DATE') THEN 'Date identifier in YYYYMMDD format'
         ELSE {_title("left(c, length(c) - 3)")} || ' identifier' END
       WHEN ends_with(c, '_DT') OR ends_with(c, '_DATE') THEN {_title("replace(replace(c, '_DT', ''), '_DATE', '')")} || ' date'
       WHEN contains(c, 'UTC') THEN {_title("c")} || ' (UTC timezone)'
       WHEN contains(c, '_USD') THEN {_title("replace(c, '_USD', '')")} || ' in USD'
       WHEN contains(c, '_EUR') THEN {_title("replace(c, '_EUR', '')")} || ' in EUR'
       WHEN regexp_matches(c, '_AMT|AMOUNT|REVENUE|COST|PRICE|SPEND') THEN {_title("c")} || ' amount'
       WHEN starts_with(c, 'IS_') THEN 'Boolean flag indicating if ' || lower(replace(substr(c, 4), '_', ' '))
       WHEN starts_with(c, 'HAS_') THEN 'Boolean flag indicating has ' || lower(replace(substr(c, 5), '_', ' '))
       WHEN ends_with(c, '_CODE') THEN {_title("left(c, length(c) - 5)")} || ' code'
       WHEN contains(c, 'QTY') OR contains(c, 'QUANTITY') THEN 'Quantity count'
       WHEN contains(c, 'COUNT') THEN 'Count of ' || lower(trim(replace(replace(c, 'COUNT', ''), '_', ' ')))
       WHEN ends_with(c, '_NAME') THEN {_title("left(c, length(c) - 5)")} || ' name'
       WHEN ends_with(c, '_DESCRIPTION') THEN {_title("replace(c, '_DESCRIPTION', '')")} || ' description'
       ELSE {_title("c")} END
"""


@query(
    "describe_column",
    f"SELECT c AS column_name, n AS column_count, {DESCRIBE_SQL} AS description FROM "
    "(SELECT column_name AS c, count(*) AS n FROM catalog_columns GROUP BY 1)",
    ("catalog_columns",),
)
def _(t):
    return t.catalog_columns.groupBy("column_name").agg(F.count(F.lit(1)).alias("column_count")).withColumn(
        "description", N.describe_column(F.col("column_name"))
    )


_ROLE = """CASE WHEN regexp_matches(column_name, '_ID$|^ID$') THEN 'foreign_key'
  WHEN regexp_matches(column_name, '(_DATE|_AT|_TS|_TIME)$') THEN 'dimension'
  WHEN regexp_matches(column_name, '^(AMOUNT|TOTAL_|SUM_|COUNT_|REVENUE|PRICE)|(_AMOUNT|_TOTAL|_COUNT|_REVENUE|_PRICE)$') THEN 'metric'
  WHEN regexp_matches(column_name, '^(IS_|HAS_|FLAG_)') OR column_name IN ('CATEGORY') THEN 'dimension' ELSE 'attribute' END"""


@query(
    "table_payload",
    f"""
    WITH p AS (SELECT column_name, min(comment) AS d FROM catalog_columns WHERE ordinal > 2 GROUP BY 1)
    SELECT {_FQN} AS full_name,
      string_agg(column_name || ':' || data_type || ':' || {_ROLE} || ':' || coalesce(d, ''), ',' ORDER BY ordinal) AS columns
    FROM catalog_columns LEFT JOIN p USING (column_name) GROUP BY 1
    """,
    ("catalog_columns",),
)
def _(t):
    texts = (
        t.catalog_columns.filter("ordinal > 2").groupBy(F.col("column_name").alias("name")).agg(F.min("comment").alias("description"))
    )
    line = F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["type"], c["role"], F.coalesce(c["description"], F.lit(""))))
    return K.table_payload(raw_concepts(t), texts).select("full_name", F.array_join(line, ",").alias("columns"))


@query(
    "search_text",
    f"""
    WITH c AS (SELECT database_name, schema_name, table_name, string_agg(column_name, ' ' ORDER BY ordinal) AS names
               FROM catalog_columns GROUP BY 1, 2, 3)
    SELECT {_FQN} AS full_name, concat_ws(' ', table_name, schema_name, database_name, comment, names) AS search_text
    FROM catalog_tables JOIN c USING (database_name, schema_name, table_name)
    """,
    ("catalog_tables", "catalog_columns"),
)
def _(t):
    return K.search_text(raw_concepts(t), F.col("comment"))


@query(
    "rich_search_text",
    """
    WITH c AS (SELECT database_name, schema_name, table_name, string_agg(column_name, ' ' ORDER BY ordinal) AS names,
                 string_agg(comment, ' ' ORDER BY ordinal) AS notes
               FROM catalog_columns GROUP BY 1, 2, 3)
    SELECT full_name, concat_ws(' ', table_name, description, array_to_string(keywords, ' '), names, notes) AS search_text
    FROM concepts JOIN c USING (database_name, schema_name, table_name)
    """,
    ("catalog_tables", "catalog_columns", "concepts"),
)
def _(t):
    return K.rich_search_text(t.concepts, t.catalog_columns)


@query(
    "enrich_free",
    f"""
    SELECT t.full_name, CASE WHEN coalesce(comment, '') <> '' THEN comment ELSE 'Table ' || t.table_name END AS description,
      CASE WHEN coalesce(comment, '') <> '' THEN 0.40::DOUBLE ELSE 0.25 END AS quality_score,
      'HEURISTIC' AS enrichment_source, CASE WHEN enriched_at IS NULL THEN 'insert' ELSE 'update' END AS action
    FROM (SELECT *, {_FQN} AS full_name FROM catalog_tables) t LEFT JOIN concepts c USING (full_name)
    WHERE enriched_at IS NULL OR {_AS_OF} > enriched_at
    """,
    ("catalog_tables", "concepts"),
)
def _(t):
    return K.enrich_free(raw_concepts(t), t.concepts)


def classes_of(t):
    """Ontology classes: one per catalog table of two brands."""
    return t.catalog_tables.filter("owner in ('ROLE_1', 'ROLE_2')").select(
        F.concat(F.lit("Class"), F.col("part_key").cast("string")).alias("class_name"),
        F.col("table_name").alias("source_table"),
        K.full_name().alias("source_name"),
        F.concat(F.lit("Business meaning of "), F.lower("table_name")).alias("description"),
        "part_key",
        "database_name",
        "schema_name",
    )


CLASSES_SQL = f"""classes AS (SELECT 'Class' || CAST(part_key AS VARCHAR) AS class_name, table_name AS source_table, {_FQN} AS source_name,
  'Business meaning of ' || lower(table_name) AS description FROM catalog_tables WHERE owner IN ('ROLE_1', 'ROLE_2'))"""


@query(
    "enrich_from_ontology",
    f"""
    WITH {CLASSES_SQL}
    SELECT source_name AS full_name, class_name, description, 0.90::DOUBLE AS quality_score, CAST(0 AS BIGINT) AS tier,
      CASE WHEN source_name IN (SELECT full_name FROM concepts) THEN 'update' ELSE 'insert' END AS action
    FROM classes
    """,
    ("catalog_tables", "concepts"),
)
def _(t):
    return K.enrich_from_ontology(raw_concepts(t), classes_of(t), t.concepts)


@query(
    "enrichment_queue",
    """
    SELECT *, CAST((position - 1) // 20 + 1 AS BIGINT) AS batch FROM (
      SELECT full_name, quality_score, usage_count, row_number() OVER (ORDER BY usage_count DESC, full_name) AS position
      FROM concepts WHERE is_active AND quality_score < 0.5) WHERE position <= 25
    """,
    ("catalog_tables", "concepts"),
)
def _(t):
    return K.enrichment_queue(t.concepts, 1)


@query(
    "apply_enrichment",
    """
    SELECT full_name, CASE WHEN quality_score < 0.6 THEN 'Described ' || table_name ELSE description END AS description,
      CASE WHEN quality_score < 0.6 THEN 0.75::DOUBLE ELSE quality_score END AS quality_score,
      CASE WHEN quality_score < 0.6 THEN CAST(2 AS BIGINT) ELSE tier END AS tier
    FROM concepts
    """,
    ("catalog_tables", "concepts"),
)
def _(t):
    results = t.concepts.filter("quality_score < 0.6").select(
        "full_name", F.concat(F.lit("Described "), F.col("table_name")).alias("description")
    )
    return K.apply_enrichment(t.concepts, results, 2)


@query(
    "quality_score",
    """
    SELECT full_name, round(CASE WHEN length(description) > 20 THEN 0.30::DOUBLE ELSE 0.0 END
      + CASE WHEN len(keywords) >= 3 THEN 0.15::DOUBLE ELSE 0.0 END + CASE WHEN row_count > 0 THEN 0.20::DOUBLE ELSE 0.0 END
      + CASE WHEN has_joins THEN 0.15::DOUBLE ELSE 0.0 END + CASE WHEN has_metrics THEN 0.10::DOUBLE ELSE 0.0 END
      + CASE WHEN has_samples THEN 0.10::DOUBLE ELSE 0.0 END, 2) AS quality_score
    FROM concepts
    """,
    ("catalog_tables", "concepts"),
)
def _(t):
    return K.quality_score(t.concepts, F.col("row_count") > 0)


@query(
    "enrichment_cost",
    f"""
    WITH c AS (SELECT {_FQN} AS full_name,
                 count(*) FILTER (NOT regexp_matches(column_name, '_(ID|KEY|DATE|TIME|AMOUNT|TOTAL|NAME|TYPE|STATUS|FLAG)$')) AS unclear,
                 bool_or(data_type = 'VARIANT') AS v FROM catalog_columns GROUP BY 1),
    x AS (SELECT count(*) FILTER (coalesce(comment, '') <> '') AS d,
                 coalesce(sum(unclear) FILTER (coalesce(comment, '') = ''), 0) AS u,
                 count(*) FILTER (coalesce(comment, '') = '') AS b, count(*) FILTER (v) AS s
          FROM (SELECT *, {_FQN} AS full_name FROM catalog_tables) JOIN c USING (full_name))
    SELECT d AS tier_0_free, round(u * 0.001::DOUBLE, 4) AS tier_1_est_credits, round(b * 0.01::DOUBLE, 4) AS tier_2_est_credits,
           round(s * 0.05::DOUBLE, 4) AS tier_3_est_credits,
           round(u * 0.001::DOUBLE + b * 0.01::DOUBLE + s * 0.05::DOUBLE, 4) AS total_est_credits
    FROM x
    """,
    ("catalog_tables", "catalog_columns"),
)
def _(t):
    return K.enrichment_cost(raw_concepts(t))


def _enrichment_log(t):
    return t.table("events").select(
        "ts", (F.col("user_id") % 4).alias("tier"), F.round(F.col("value") / 1000, 6).alias("credits")
    )


@query(
    "spend_by_day",
    """
    SELECT CAST(ts AS DATE) AS day, user_id % 4 AS tier, count(*) AS calls,
           round(CAST(sum(CAST(round(value / 1000, 6) AS DECIMAL(20,6))) AS DOUBLE), 6) AS credits
    FROM events GROUP BY 1, 2
    """,
)
def _(t):
    return K.spend_by_day(_enrichment_log(t))


@query(
    "spend_status",
    """
    WITH x AS (SELECT round(coalesce(CAST(sum(CAST(round(value / 1000, 6) AS DECIMAL(20,6))) AS DOUBLE), 0), 6) AS total_today
               FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15')
    SELECT total_today, 5.0::DOUBLE AS budget, round(total_today * 100 / 5.0::DOUBLE, 2) AS pct_used,
           CASE WHEN total_today >= 4.0 THEN 'WARNING' ELSE 'OK' END AS status FROM x
    """,
)
def _(t):
    return K.spend_status(_enrichment_log(t), "2024-01-15", 5.0)


@query(
    "upsert_config",
    f"""
    WITH cfg AS (SELECT database_name AS domain, 'owner_of_' || schema_name || '_' || table_name AS key, owner AS value
                 FROM catalog_tables WHERE size_code < 40),
    ovr AS (SELECT CASE WHEN size_code = 50 THEN 'NOWHERE' ELSE database_name END AS domain,
              'owner_of_' || schema_name || '_' || table_name AS key, 'ROLE_X' AS value FROM catalog_tables WHERE size_code > 30)
    SELECT domain, key, coalesce(o.value, c.value) AS value,
      CASE WHEN domain NOT IN (SELECT database_name FROM catalog_tables) THEN 'UNKNOWN_DOMAIN' WHEN c.value IS NULL THEN 'ADDED'
           WHEN o.value IS NULL THEN 'KEPT' ELSE 'UPDATED' END AS status
    FROM cfg c FULL JOIN ovr o USING (domain, key)
    """,
    ("catalog_tables",),
)
def _(t):
    key = F.concat(F.lit("owner_of_"), F.col("schema_name"), F.lit("_"), F.col("table_name")).alias("key")
    c = t.catalog_tables
    config = c.filter("size_code < 40").select(F.col("database_name").alias("domain"), key, F.col("owner").alias("value"))
    overrides = c.filter("size_code > 30").select(
        F.when(F.col("size_code") == 50, "NOWHERE").otherwise(F.col("database_name")).alias("domain"), key, F.lit("ROLE_X").alias("value")
    )
    return K.upsert_config(config, overrides, c.select(F.col("database_name").alias("domain")))


_DOMAIN_NAME = "regexp_replace(database_name, '(_DB|_DW|_PROD|_DEV|_STAGE|_STG)$', '')"


@query(
    "config_summary",
    f"""
    WITH s AS (SELECT *, {_DOMAIN_NAME} AS domain FROM catalog_tables),
    old AS (SELECT domain, max(size_code % 4) AS tier FROM s GROUP BY 1),
    new AS (SELECT domain, max(size_code % 3) AS tier FROM s WHERE schema_name = 'MART' AND database_name LIKE '%PROD' GROUP BY 1),
    n AS (SELECT domain, count(DISTINCT database_name) AS database_count FROM s GROUP BY 1)
    SELECT domain, database_count, CAST(coalesce(new.tier, CASE WHEN length(domain) > 3 THEN old.tier END, 0) AS VARCHAR) AS tier,
      CASE WHEN new.tier IS NULL THEN CAST(0 AS BIGINT) ELSE 1 END AS changed_settings
    FROM n LEFT JOIN old USING (domain) LEFT JOIN new USING (domain)
    """,
    ("catalog_tables",),
)
def _(t):
    s = t.catalog_tables.withColumn("domain", domain_of("database_name"))
    setting = lambda df, n: df.groupBy("domain").agg(F.max(F.col("size_code") % n).cast("string").alias("value")).select("domain", F.lit("enrichment_max_tier").alias("key"), "value")
    config = setting(s.filter(F.length("domain") > 3), 4)
    overrides = setting(s.filter("schema_name = 'MART' and database_name like '%PROD'"), 3)
    return K.config_summary(K.upsert_config(config, overrides, s.select("domain")), s.select("domain", "database_name"))


@query(
    "union_domains",
    """
    SELECT domain AS source_domain, full_name, quality_score FROM concepts
    WHERE is_active AND domain IN ('SALES', 'FINANCE', 'OPS', 'PEOPLE')
    """,
    ("catalog_tables", "concepts"),
)
def _(t):
    parts = {d: t.concepts.filter(F.col("domain") == d) for d in ("SALES", "FINANCE", "OPS", "PEOPLE")}
    return K.union_domains({**parts, "GONE": None}).select("source_domain", "full_name", "quality_score")
