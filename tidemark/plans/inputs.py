"""Canonical input relations, derived by Spark from the driver tables.

The tables hold no query log and no catalog, so each operator reads a relation
computed from them; it has one row (or more) per row of its source table, and
so grows with it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exact import as_large

AS_OF = "2001-08-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
N_SHARED_OBJECTS = 200

DATABASES = [
    "SALES_PROD", "SALES_DEV", "FINANCE_DW", "OPS_DB", "MARKETING_STAGE", "SUPPLY_PROD", "PEOPLE", "WEB_STG",
]
SCHEMAS = ["CORE", "RAW", "MART"]
PREFIXES = ["FCT_", "STG_", "DIM_", "MART_", "", ""]
WORDS = ["ORDERS", "CUSTOMER", "PRODUCT", "SHIPMENT", "INVOICE", "CAMPAIGN", "EMPLOYEE"]
COLUMNS = [
    "CUSTOMER_ID", "ORDER_DATE", "TOTAL_AMOUNT", "STATUS_CODE", "IS_ACTIVE", "REGION", "QUANTITY", "UNIT_PRICE",
    "CREATED_AT", "EMAIL", "PRODUCT_NAME", "ITEM_COUNT", "PAYLOAD", "ETL_BATCH", "ITEM_DESCRIPTION", "ACCT_ID",
    "SALE_DT", "NET_USD", "HAS_DISCOUNT", "MARGIN_PCT", "CATEGORY", "LOAD_TS_UTC", "TAX_EUR", "NOTES",
]
TYPES = [
    "NUMBER", "DATE", "NUMBER", "VARCHAR", "BOOLEAN", "VARCHAR", "NUMBER", "FLOAT",
    "TIMESTAMP", "VARCHAR", "VARCHAR", "NUMBER", "VARIANT", "VARCHAR", "VARCHAR", "NUMBER",
    "DATE", "NUMBER", "BOOLEAN", "FLOAT", "VARCHAR", "TIMESTAMP", "NUMBER", "VARCHAR",
]
MESSAGES = [
    "Object 'ORDERS' does not exist or not authorized",
    "Statement timeout after 3600 seconds",
    "Numeric value 'abc' is not recognized",
    "Insufficient privileges to operate on schema",
    "Upstream refresh failed for DIM_DATE",
    "Out of memory while executing",
    "Invalid identifier 'REGION'",
    "Network connection reset by peer",
]
RUN_MODES = ["FULL", "FOCUSED", "STALENESS"]
SKILLS = ["rule-reviewer", "plan-reviewer", "doc-reviewer", "rule-creator", "other"]
MODELS = ["model-a", "model-b", "model-c"]
DOMAINS = ["Sales", "Finance", "", "Supply Chain", "R & D"]

# Shapes of the query log; the marks are filled with names and numbers of the row.
TEMPLATES = [
    "SELECT o.CUSTOMER_ID, SUM(o.TOTAL_AMOUNT) AS total_amount FROM {t1} o JOIN {t2} c ON o.CUSTOMER_ID = c.CUSTOMER_ID "
    "WHERE ORDER_DATE >= '2000-01-01' AND o.REGION = 'R{n}' GROUP BY o.CUSTOMER_ID",
    "-- nightly load from the staging area\nINSERT INTO {t1} SELECT * FROM {t2}",
    "SELECT COUNT(*) FROM {short} /* probe\n run */ WHERE STATUS_CODE = 'A{n}'",
    "select c.REGION, count(distinct o.CUSTOMER_ID) from {t1} as o left join {t2} as c on o.CUSTOMER_ID = c.CUSTOMER_ID "
    "where c.STATUS_CODE = 'A' group by REGION order by REGION",
    "CREATE OR REPLACE TEMPORARY TABLE TMP_{n} AS SELECT * FROM {t1}",
    "SELECT CASE WHEN i.QUANTITY > 10 THEN 'big' ELSE 'small' END AS bucket, AVG(i.UNIT_PRICE), MAX( i.QUANTITY ) "
    "FROM {t1} i WHERE QUANTITY > {n} AND CATEGORY = 'C1' GROUP BY 1",
    "SELECT p.PAYLOAD:customer:id::STRING, PARSE_JSON(p.NOTES) FROM {t1} p, LATERAL FLATTEN(input => p.PAYLOAD) f "
    "WHERE p.CREATED_AT >= DATEADD(MIN, -15, CURRENT_DATE)",
    "WITH recent AS (SELECT s.CUSTOMER_ID, MAX(s.ORDER_DATE) AS last_date FROM {t1} s GROUP BY s.CUSTOMER_ID) "
    "SELECT r.CUSTOMER_ID, ROW_NUMBER() OVER (ORDER BY r.last_date) FROM recent r JOIN {t2} d ON r.CUSTOMER_ID = d.CUSTOMER_ID",
    "UPDATE {t1} SET STATUS_CODE = 'B' WHERE ACCT_ID = {n}",
    "SELECT * FROM INFORMATION_SCHEMA.COLUMNS WHERE TABLE_NAME = '{bare}'",
    "SELECT MIN(a.NET_USD), COUNT(1), SUM(b.TAX_EUR + a.NET_USD) FROM {t1} a JOIN {t2} b ON a.ACCT_ID = b.ACCT_ID "
    "JOIN {t3} e ON b.ACCT_ID = e.ACCT_ID // trailing note",
    "SELECT SEARCH_PREVIEW('docs_index', 'FILTER REGION = X') FROM {t1} WHERE EMAIL IS NOT NULL",
]
QUERY_TYPES = [
    "SELECT", "INSERT", "SELECT", "SELECT", "CREATE_TABLE_AS_SELECT", "SELECT", "SELECT", "SELECT",
    "UPDATE", "SHOW", "SELECT", "SELECT",
]


# Tables on which the work per row is heavy: texts, and orders as the query log.
TEXT_TABLES = ("documents", "pages", "conversations")


def pick(values: list[str], index: Column) -> Column:
    """Element of a fixed list by a non-negative index, wrapping around."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int"))


def database_of(k: Column) -> Column:
    return pick(DATABASES, k)


def schema_of(k: Column) -> Column:
    return pick(SCHEMAS, k)


def table_of(k: Column) -> Column:
    return F.concat(pick(PREFIXES, k), pick(WORDS, k), k.cast("string"))


def full_name(k: Column) -> Column:
    return F.concat_ws(".", database_of(k), schema_of(k), table_of(k))


def parent_of(k: Column) -> Column:
    """Referenced table of a table: another one of the same database."""
    return F.floor(k / 16) * 8 + F.pmod(k, F.lit(8))


class Inputs:
    """Lazy access to the driver tables in one folder and the relations over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._spread(df) if name in TEXT_TABLES else df

    def _spread(self, df: DataFrame) -> DataFrame:
        """Spread a table kept in fewer files than there are cores before heavy work per row."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if len(df.inputFiles()) < cores else df

    @cached_property
    def query_log(self) -> DataFrame:
        o = self._spread(self.table("orders"))
        c = F.col("o_custkey")
        k1 = c % N_SHARED_OBJECTS
        k2 = (c * 7 + 3) % N_SHARED_OBJECTS
        k3 = (c * 11 + 5) % N_SHARED_OBJECTS
        t1, t2, t3 = full_name(k1), full_name(k2), full_name(k3)
        text = pick(TEMPLATES, F.col("o_orderkey"))
        for mark, value in {
            "{t1}": full_name(k1),
            "{t2}": full_name(k2),
            "{t3}": full_name(k3),
            "{short}": F.concat_ws("..", database_of(k1), table_of(k1)),
            "{bare}": table_of(k1),
            "{n}": (c % 30).cast("string"),
        }.items():
            text = F.replace(text, F.lit(mark), value)
        return o.select(
            F.col("o_orderkey").alias("query_id"),
            F.concat(F.lit("U"), (c % 50).cast("string")).alias("user_name"),
            text.alias("query_text"),
            F.col("o_orderdate").alias("start_time"),
            F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("SUCCESS").alias("status"),
            database_of(k1).alias("database_name"),
            F.col("o_totalprice").alias("elapsed_ms"),
            pick(QUERY_TYPES, F.col("o_orderkey")).alias("query_type"),
            pick(DOMAINS, c).alias("domain"),
            F.when(F.pmod(F.col("o_orderkey"), F.lit(4)) == 3, "")
            .otherwise(F.concat(F.lit("What is the total by region for group "), (c % 50).cast("string"), F.lit("?")))
            .alias("question"),
        )

    @cached_property
    def access_log(self) -> DataFrame:
        """One row per query: the objects it read, as an array of (name, domain)."""
        li = self.table("lineitem").select("l_orderkey", (F.col("l_partkey") % N_SHARED_OBJECTS).alias("k"))
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        # only numbers are shuffled; the names are built after it. Dealt into a named number of parts: numbers compress so
        # well that Spark would join its own parts into a few, each of which holds the lists of millions of queries
        parts = 16 * self.spark.sparkContext.defaultParallelism
        lists = li.repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.collect_list("k").alias("ks"))

        def named(k: Column) -> Column:
            domain = F.when(k % 25 == 9, "Stage").when(k % 10 == 3, "View").otherwise("Table")
            return F.struct(full_name(k).alias("object_name"), domain.alias("object_domain"))

        return lists.join(as_large(o), F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_orderkey").alias("query_id"),
            F.concat(F.lit("U"), (F.col("o_custkey") % 50).cast("string")).alias("user_name"),
            F.col("o_orderdate").alias("ts"),
            F.transform("ks", named).alias("objects"),
        )

    @cached_property
    def catalog_tables(self) -> DataFrame:
        k, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
        rows = F.when(size <= 2, F.lit(0)).otherwise(F.floor(F.col("p_retailprice") * size * 1000)).cast("bigint")
        day = F.lit(AS_OF).cast("timestamp_ntz")
        return self.table("part").select(
            database_of(k).alias("database_name"),
            schema_of(k).alias("schema_name"),
            table_of(k).alias("table_name"),
            F.when(size % 10 == 3, "VIEW").otherwise("BASE TABLE").alias("table_type"),
            rows.alias("row_count"),
            (rows * (size + 7)).alias("bytes"),
            (rows * (size % 4)).alias("retained_bytes"),
            F.when(~F.col("p_type").isin("ECONOMY", "PROMO"), F.col("p_name")).alias("comment"),
            (day - F.make_dt_interval((size * 20 + k % 500).cast("int"))).alias("created"),
            (day - F.make_dt_interval((size * size % 400).cast("int"))).alias("last_altered"),
            F.concat(F.lit("ROLE_"), F.regexp_replace("p_brand", "Brand#", "")).alias("owner"),
            k.alias("part_key"),
            size.alias("size_code"),
        )

    def _columns(self, newer: bool) -> DataFrame:
        k, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
        n = F.lit(2) + size % 8
        if newer:
            n = n + F.when(size.isin(11, 22, 33, 44), F.lit(1)).otherwise(F.lit(0))
        base = self.table("part")
        if newer:
            base = base.filter(~F.col("p_size").isin(17, 34))
        # a small file is few tasks, each of which would hold the columns of all its tables at once
        spread = base.select("p_partkey", "p_size").repartition(4 * self.spark.sparkContext.defaultParallelism)
        rows = spread.select(
            k.alias("k"), size.alias("size"), F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("ordinal")
        )
        k, i = F.col("k"), F.col("ordinal").cast("bigint")
        at = k * 3 + i * 5
        name = (
            F.when(i == 1, F.lit("ID"))
            .when(i == 2, F.concat(table_of(parent_of(k)), F.lit("_ID")))
            .otherwise(pick(COLUMNS, at))
        )
        kind = F.when(i <= 2, F.lit("NUMBER")).otherwise(pick(TYPES, at))
        precision = F.when(kind == "NUMBER", F.lit(18)).cast("bigint")
        length = F.when(kind == "VARCHAR", F.lit(64)).cast("bigint")
        if newer:
            retyped = F.col("size").isin(13, 26, 39) & (i == 3)
            precision = F.when(kind == "NUMBER", F.when(F.col("size") == 9, 38).otherwise(18)).cast("bigint")
            length = F.when(kind == "VARCHAR", F.when(F.col("size") == 10, 256).otherwise(64)).cast("bigint")
            kind = F.when(retyped, F.lit("VARIANT")).otherwise(kind)
        return rows.select(
            database_of(k).alias("database_name"),
            schema_of(k).alias("schema_name"),
            table_of(k).alias("table_name"),
            name.alias("column_name"),
            kind.alias("data_type"),
            precision.alias("numeric_precision"),
            length.alias("char_length"),
            (i % 3 != 1).alias("nullable"),
            F.when((k + i) % 4 == 0, F.concat(F.lit("Holds "), F.lower(name))).alias("comment"),
            i.alias("ordinal"),
        )

    @cached_property
    def catalog_columns(self) -> DataFrame:
        return self._columns(newer=False)

    @cached_property
    def catalog_columns_new(self) -> DataFrame:
        return self._columns(newer=True)

    @cached_property
    def constraints(self) -> DataFrame:
        """Declared foreign keys of about a sixth of the tables."""
        k = F.col("p_partkey")
        p = parent_of(k)
        return self.table("part").filter((F.col("p_type") == "LARGE") & (k != p)).select(
            database_of(k).alias("database_name"),
            schema_of(k).alias("schema_name"),
            table_of(k).alias("table_name"),
            F.concat(F.lit("FK_"), k.cast("string")).alias("constraint_name"),
            F.lit("FOREIGN KEY").alias("constraint_type"),
            F.concat(table_of(p), F.lit("_ID")).alias("column_name"),
            table_of(p).alias("ref_table"),
            F.lit("ID").alias("ref_column"),
        )

    @cached_property
    def current_tables(self) -> DataFrame:
        """Catalog of today: the older snapshot without the dropped tables."""
        return self.catalog_tables.filter(~F.col("size_code").isin(17, 34))

    @cached_property
    def concepts(self) -> DataFrame:
        """Enriched catalog entries; tables of one type never got one."""
        size, k = F.col("size_code"), F.col("part_key")
        known = self.table("part").filter("p_type <> 'STANDARD'").select("p_partkey")
        return (
            self.catalog_tables.join(known, k == F.col("p_partkey"), "left_semi")
            .select(
                F.concat(F.lit("C"), k.cast("string")).alias("concept_id"),
                "database_name",
                "schema_name",
                "table_name",
                F.concat_ws(".", "database_name", "schema_name", "table_name").alias("full_name"),
                F.regexp_replace("database_name", "(_DB|_DW|_PROD|_DEV|_STAGE|_STG)$", "").alias("domain"),
                F.col("comment").alias("description"),
                F.transform(F.sequence(F.lit(1), (size % 5 + 1).cast("int")), lambda i: F.concat(F.lit("kw"), ((i * 7 + k) % 30).cast("string"))).alias("keywords"),
                (size % 4 > 0).alias("has_joins"),
                (size % 3 > 0).alias("has_metrics"),
                (size % 2 > 0).alias("has_samples"),
                F.round((size * 7 % 100) / 100.0, 2).alias("quality_score"),
                (size % 4).alias("tier"),
                (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval((size * 3 % 200).cast("int"))).alias("enriched_at"),
                (size != 5).alias("is_active"),
                (k * 31 % 37).alias("usage_count"),
                "row_count",
                "last_altered",
                "part_key",
                "size_code",
            )
        )

    @cached_property
    def question_log(self) -> DataFrame:
        """Questions of users: one row per user turn, with the concepts that answered it."""
        n = F.length("text").cast("bigint")
        c, t = F.col("conv_id"), F.col("turn")
        return self.table("conversations").filter("role = 'user'").select(
            (c * 1000 + t).alias("question_id"),
            F.col("text").alias("question"),
            (F.lit(EVENTS_AS_OF).cast("timestamp_ntz") - F.make_dt_interval((c % 120).cast("int"))).alias("asked_at"),
            F.when(n % 7 == 0, "ERROR").when(n % 11 == 0, "EMPTY").otherwise("OK").alias("status"),
            F.when(n % 7 == 0, pick(MESSAGES, n)).alias("error_message"),
            (n % 3 != 0).alias("helpful"),
            F.array_distinct(
                F.array(
                    F.concat(F.lit("C"), (c % 40).cast("string")), F.concat(F.lit("C"), ((c + t) % 40).cast("string"))
                )
            ).alias("concepts_used"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        """Acyclic graph over parts: a binary tree and some cross edges."""
        p = self.table("part").filter(F.col("p_partkey") > 0)
        k = F.col("p_partkey")
        parents = F.array_compact(
            F.array(
                F.floor(k / 2),
                F.when(F.col("p_type") == "PROMO", F.floor(k / 3)),
            )
        )
        return p.select(k.alias("child"), F.explode(F.array_distinct(parents)).alias("parent"))

    @cached_property
    def run_history(self) -> DataFrame:
        failed = F.col("event_type") == "error"
        return self.table("events").select(
            F.col("event_id").alias("run_id"),
            F.concat(F.lit("JOB_"), F.col("user_id").cast("string")).alias("object_name"),
            F.when(F.col("user_id") % 2 == 0, "TASK").otherwise("DERIVED_TABLE").alias("object_type"),
            F.when(failed, "FAILED").otherwise("SUCCEEDED").alias("state"),
            F.col("ts"),
            F.when(failed, pick(MESSAGES, F.col("event_id") * 5 + F.col("user_id"))).alias("message"),
            F.col("value"),
            F.col("user_id"),
        )

    @cached_property
    def failures(self) -> DataFrame:
        """Recorded failures with the state of their repair."""
        r = self.run_history.filter("state = 'FAILED'")
        k = F.col("run_id")
        return r.select(
            k.alias("failure_id"),
            "object_name",
            "object_type",
            F.col("ts").alias("detected_at"),
            F.col("message").alias("error_message"),
            pick(["RESOLVED", "ESCALATED", "PENDING_REVIEW", "NEW"], k * 7 + F.col("user_id")).alias("status"),
            ((k * 3 + F.col("user_id")) % 5).alias("fix_attempts"),
            F.col("user_id").alias("node"),
        )

    @cached_property
    def audit_log(self) -> DataFrame:
        """What the repair of failures did: one row per event."""
        k = F.col("event_id")
        return self.table("events").select(
            k.alias("log_id"),
            F.col("user_id").alias("failure_id"),
            pick(["DIAGNOSE", "DIAGNOSE_DT", "EXECUTE", "VERIFY"], k).alias("action_type"),
            pick(["RUNBOOK", "model-a", "model-b"], k + F.col("user_id")).alias("model_used"),
            pick(["PASS", "REVIEW:LOW_CONFIDENCE", "BLOCK:BLOCKED_OPERATION"], k * 5 + F.col("user_id")).alias("guardrail_result"),
            F.round(F.pmod(F.col("value"), F.lit(100.0)) / 100, 2).alias("confidence"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def timing_runs(self) -> DataFrame:
        """Finished runs; the event value is the duration in seconds."""
        return self.table("events").select(
            F.substring(F.md5(F.col("event_id").cast("string")), 1, 16).alias("run_id"),
            pick(SKILLS, F.col("event_id")).alias("skill_name"),
            pick(RUN_MODES, F.col("user_id")).alias("mode"),
            pick(MODELS, F.col("user_id") % 7).alias("model"),
            F.col("ts").alias("started"),
            F.col("value").alias("duration_seconds"),
            (F.col("event_id") % 5000).alias("input_tokens"),
            (F.col("event_id") % 700).alias("output_tokens"),
            F.col("user_id"),
        )

    @cached_property
    def eval_scores(self) -> DataFrame:
        """Long-form scores: the event value, folded into 0..1, per question, metric and run."""
        e = F.col("event_id")
        return self.table("events").select(
            e.alias("score_id"),
            (F.col("user_id") % 40).alias("input_id"),
            pick(["answer_correctness", "logical_consistency", "tool_selection_accuracy"], e).alias("metric"),
            pick(["baseline", "tuned", "wide"], F.floor(e / 3)).alias("variant"),
            (F.floor(e / 9) % 5 + 1).alias("run"),
            F.when(F.col("user_id") % 20 < 9, "DEV").otherwise("TEST").alias("split"),
            (F.floor(e / 45) % 4).alias("iteration"),
            F.round(F.pmod(F.col("value"), F.lit(100.0)) / 100, 4).alias("score"),
            F.when(F.col("event_type") == "signup", "revalidation").otherwise("sweep").alias("source"),
            (F.col("event_type") == "error").alias("is_error"),
        )

    @cached_property
    def eval_questions(self) -> DataFrame:
        i = F.col("item_id")
        truth = F.when(i % 7 == 0, F.lit(None)).when(
            i % 7 == 1, F.lit("{}")
        ).when(i % 7 == 2, F.lit('{"ground_truth_output": " "}')).otherwise(
            F.concat(F.lit('{"ground_truth_output": "answer '), i.cast("string"), F.lit('"}'))
        )
        return self.table("benchmark").select(
            i.alias("test_id"),
            pick(["lookup", "trend", "compare", "rank", "explain", "forecast"], i * i).alias("test_category"),
            F.col("text").alias("input_query"),
            truth.alias("ground_truth"),
            F.when(i % 9 < 4, "DEV").otherwise("TEST").alias("split"),
        )
