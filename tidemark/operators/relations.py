"""Relations between tables: declared, inferred, shared columns, ontology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exact import as_large, null_safe_join, pick_bounded
from tidemark.operators.catalog import TABLE_KEY, full_name

# Fixed value: facts, and dimensions, of one key that meet at once. A key that fewer pairs than its square can share is rare.
TABLES_PER_BLOCK = 1024

# Fixed value: parts for each core of what is sorted by names. Names compress so well that Spark would join its own parts
# into a few, each of which sorts millions of rows.
PARTS_PER_CORE = 16

EDGE = [
    "source_table", "source_column", "target_table", "target_column", "relationship_type", "confidence", "detection_method",
]


def dealt(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition(PARTS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, *by)


def edge(source: str, column: str, target: str, target_column: Column, kind: str, confidence: float, method: str):
    return [
        F.col(source).alias("source_table"),
        F.col(column).alias("source_column"),
        F.col(target).alias("target_table"),
        target_column.alias("target_column"),
        F.lit(kind).alias("relationship_type"),
        F.lit(confidence).alias("confidence"),
        F.lit(method).alias("detection_method"),
    ]


def relations_declared(constraints: DataFrame, tables: DataFrame) -> DataFrame:
    """Foreign keys joined to the referenced table of the same database."""
    target = pick_bounded(
        tables.select(F.col("database_name").alias("_db"), F.upper("table_name").alias("_t"), full_name().alias("_target")),
        ["_db", "_t"],
        [F.col("_target")],
        1,
    )
    return (
        constraints.filter(F.col("constraint_type") == "FOREIGN KEY")
        .withColumn("_source", full_name())
        .join(as_large(target), (F.col("database_name") == F.col("_db")) & (F.upper("ref_table") == F.col("_t")))
        .select(*edge("_source", "column_name", "_target", F.col("ref_column"), "FK", 1.0, "CONSTRAINT"))
    )


def relations_inferred(columns: DataFrame) -> DataFrame:
    """Column X_ID taken as a reference to table X, XS, or X without its trailing S.

    The first of the three names that exists decides: in the same database and
    schema if there, else the smallest full name of that name. A match with the
    table itself gives no edge. A column name is looked up once per schema, not
    once per table, so a name that many tables share stays a few rows.
    """
    named = columns.groupBy(*TABLE_KEY).agg(
        F.struct(full_name().alias("f"), F.max(F.upper("column_name") == "ID").alias("h")).alias("_m")
    ).withColumn("_t", F.upper("table_name"))
    local = dealt(named, "database_name", "schema_name", "_t").groupBy(F.col("database_name").alias("_db"), F.col("schema_name").alias("_sc"), F.col("_t").alias("_lt")).agg(
        F.min("_m").alias("_near")
    )
    anywhere = dealt(named, "_t").groupBy(F.col("_t").alias("_at")).agg(F.min("_m").alias("_far"))

    name = F.upper("column_name")
    base = F.substring(name, F.lit(1), F.length(name) - 3)
    options = F.array(base, F.concat(base, F.lit("S")), F.when(base.endswith("S"), F.substring(base, F.lit(1), F.length(base) - 1)))
    place = ["database_name", "schema_name", "column_name"]
    refs = columns.filter(name.rlike("_ID$"))
    asked = refs.select(*place).distinct().select(*place, F.posexplode(options).alias("_p", "_o"))
    asked = asked.filter(F.col("_o").isNotNull())  # most names have no third option; together these would be one task's rows
    near = (F.col("database_name") == F.col("_db")) & (F.col("schema_name") == F.col("_sc")) & (F.col("_o") == F.col("_lt"))
    answers = (
        dealt(asked.join(as_large(local), near, "left"), "_o")
        .join(as_large(anywhere), F.col("_o") == F.col("_at"), "left")
        .withColumn("_hit", F.coalesce("_near", "_far"))
        .filter(F.col("_hit").isNotNull())
        .groupBy(*place)
        .agg(F.min(F.struct("_p", "_hit")).alias("_b"))
    )
    met = null_safe_join(refs.select(*place, full_name().alias("_source")), as_large(answers), place)
    first = (
        dealt(met.select("_source", "column_name", "_b"), "_source", "column_name")
        .groupBy("_source", "column_name")
        .agg(F.min("_b").alias("_b"))
        .withColumn("_target", F.col("_b._hit.f"))
    )
    return first.filter(F.col("_source") != F.col("_target")).select(
        *edge("_source", "column_name", "_target", F.lit("ID"), "INFERRED_FK", 0.85, "NAME_MATCH"),
        F.col("_b._hit.h").alias("target_has_column"),
    )


def relations_first_column(columns: DataFrame) -> DataFrame:
    """Variant of the inference that takes the first column of a table as its key.

    The two alternatives, TABLE_ID and an equal name, are two equi-joins; each key
    name is represented by its smallest table so that a common name stays one row.
    """
    keys = columns.filter(F.col("ordinal") == 1).select(
        F.col("database_name").alias("_db"), F.upper("table_name").alias("_t"), F.upper("column_name").alias("_k"), full_name().alias("_target")
    )
    usable = columns.filter(F.col("data_type").isin("NUMBER", "VARCHAR", "TEXT")).select(
        "database_name", full_name().alias("_source"), F.upper("column_name").alias("_c"), "ordinal"
    )
    out = None
    for named in (F.concat("_t", F.lit("_ID")), F.col("_k")):
        least = keys.groupBy("_db", named.alias("_name")).agg(F.min(F.struct("_target", "_k")).alias("_key"))
        s = as_large(least.select("_db", "_name", "_key._target", "_key._k"))
        hit = usable.join(s, (F.col("database_name") == F.col("_db")) & (F.col("_c") == F.col("_name"))).filter(
            F.col("_source") != F.col("_target")
        ).select(*edge("_source", "_c", "_target", F.col("_k"), "INFERRED_FK", 0.80, "FIRST_COLUMN"))
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def relations_shared(columns: DataFrame, max_schemas: int = 2) -> DataFrame:
    """Tables that share a column of the same name and base type.

    A group of n tables stands for n(n-1)/2 pairs. It is given without loss as its
    members, each tied to the first table of the group, with the number of pairs.
    """
    name = F.upper("column_name")
    base = F.get(F.split(F.upper("data_type"), r"\("), F.lit(0))
    members = columns.filter(~name.rlike("_ID$|^ID$")).select(
        name.alias("source_column"), base.alias("base_type"), F.concat_ws(".", "database_name", "schema_name").alias("_s"),
        full_name().alias("source_table"), "database_name",
    )
    key = ["database_name", "source_column", "base_type"]
    groups = (
        members.groupBy(*key)
        .agg(
            F.count_distinct("source_table").alias("group_size"),
            F.count_distinct("_s").alias("_n"),
            F.min("source_table").alias("target_table"),
        )
        .filter((F.col("group_size") >= 2) & (F.col("_n") <= max_schemas))
        .drop("_n")
    )
    n = F.col("group_size")
    return (
        members.join(as_large(groups), key)
        .filter(F.col("source_table") != F.col("target_table"))
        .select(
            *edge("source_table", "source_column", "target_table", F.col("source_column"), "SHARED_KEY", 0.70, "NAME_MATCH"),
            "group_size",
            F.floor(n * (n - 1) / 2).alias("group_pairs"),
        )
    )


def relations_ontology(tables: DataFrame, definitions: DataFrame) -> DataFrame:
    """Relations that an ontology defines between two tables named in the catalog."""
    by_name = tables.select(F.upper("table_name").alias("_t"), full_name().alias("_full"))
    src = by_name.select(F.col("_t").alias("_st"), F.col("_full").alias("_source"))
    dst = by_name.select(F.col("_t").alias("_dt"), F.col("_full").alias("_target"))
    return (
        definitions.filter(F.col("source_table").isNotNull() & F.col("source_column").isNotNull())
        .withColumnsRenamed({"source_table": "_def_table", "source_column": "_def_column"})
        .join(src, F.upper("_def_table") == F.col("_st"))
        .join(dst, F.upper("range_table") == F.col("_dt"))
        .select(*edge("_source", "_def_column", "_target", F.coalesce("target_column", F.lit("")), "ONTOLOGY", 1.0, "ONT_REL_DEF"))
    )


def merge_relations(found: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """At most one edge per source, target and kind: the surest, then the first column."""
    key = ["source_table", "target_table", "relationship_type"]
    best = dealt(found, *key).groupBy(*key).agg(
        F.min_by(
            F.struct("source_column", "target_column", "confidence", "detection_method"),
            F.struct(-F.col("confidence"), F.col("source_column")),
        ).alias("_e")
    ).select(*key, "_e.*").select(*EDGE)
    return best if existing is None else best.join(existing.select(*key), key, "left_anti").unionByName(existing.select(*EDGE))


def _fact_dim_tables(columns: DataFrame) -> DataFrame:
    """Facts and dimensions with the keys that the other side of their database has as well: all of them, frequent and rare ones.

    A key is rare if few pairs can share it, so that these pairs may be listed.
    """
    fact, dim = F.col("_t").contains("FCT_"), F.col("_t").contains("DIM_")
    keyed = columns.filter(F.upper("column_name").rlike("(_ID|_KEY)$")).select(
        "database_name", F.upper("table_name").alias("_t"), F.upper("column_name").alias("_c")
    ).filter(fact | dim).distinct()
    both = keyed.groupBy("database_name", "_c").agg(F.count_if(fact).alias("_nf"), F.count_if(dim).alias("_nd")).filter("_nf > 0 AND _nd > 0")
    frequent = F.col("_nf") * F.col("_nd") > TABLES_PER_BLOCK**2
    listed = lambda c, name: F.sort_array(F.collect_list(c)).alias(name)
    return keyed.join(as_large(both.select("database_name", "_c", frequent.alias("_is"))), ["database_name", "_c"]).groupBy("database_name", "_t").agg(
        listed("_c", "_keys"), listed(F.when(F.col("_is"), F.col("_c")), "_often"), listed(F.when(~F.col("_is"), F.col("_c")), "_rare")
    )


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """Values of both sides by their frequent keys (`_often`), for each two sets of these that share one.

    Rows of a key are dealt by `_u` into blocks, a block is one row, and each two blocks meet by themselves, so that a
    common key is spread over all tasks. Within two blocks only different sets are compared. Two sets meet once per
    shared key and count where that key is the first they share.
    """
    key, by = ["database_name", "_c"], ["database_name", "_c", "_f", "_d"]
    sides = [df.select("database_name", "_often", "_u", "_v", F.explode("_often").alias("_c")) for df in (left, right)]
    count = lambda df, n: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / TABLES_PER_BLOCK).cast("int").alias(n))
    blocks = count(sides[0], "_nf").join(as_large(count(sides[1], "_nd")), key)
    tasks = 4 * left.sparkSession.sparkContext.defaultParallelism  # named, since the rows are few and their pairs many

    def dealt_out(df: DataFrame, own: str, n: str, other: str, m: str, sets: str) -> DataFrame:
        placed = df.join(as_large(blocks), key).withColumn(own, F.pmod(F.xxhash64("_u"), F.col(n)).cast("int"))
        alike = placed.groupBy(*key, own, m, "_often").agg(F.collect_list("_v").alias("_vs"))
        block = alike.groupBy(*key, own, m).agg(F.collect_list(F.struct("_often", "_vs")).alias(sets))
        return block.select(*key, own, F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other), sets).repartition(tasks, *by)

    met = dealt_out(sides[0], "_f", "_nf", "_d", "_nd", "_ls").join(as_large(dealt_out(sides[1], "_d", "_nd", "_f", "_nf", "_rs")), by)
    return (
        met.select("database_name", "_c", F.explode("_ls").alias("_l"), "_rs").select("database_name", "_c", "_l", F.explode("_rs").alias("_r"))
        .withColumn("_shared", F.array_intersect("_l._often", "_r._often"))
        .filter(F.get("_shared", F.lit(0)) == F.col("_c"))
        .select("database_name", "_shared", F.col("_l._often").alias("_often"), F.col("_l._vs").alias("_lv"), F.col("_r._vs").alias("_rv"))
    )


def fact_dim_relations(columns: DataFrame, keys_per_pair: int = 3, counted: bool = False) -> DataFrame:
    """Facts and dimensions of a database that share key columns, one row per pair; or `counted`, one row per fact with the number of its pairs.

    Pairs that share a rare key are joined on it. All others share frequent keys only; they come out of blocks of tables,
    where sets of keys are compared, not pairs, so pairs are neither grouped nor written to disk. Counts need no pairs:
    sets of frequent keys are counted, and pairs that share rare keys alone are added.
    """
    tables = _fact_dim_tables(columns)
    facts, dims = (tables.filter(F.col("_t").contains(mark)) for mark in ("FCT_", "DIM_"))
    side = lambda df, mark: df.select("database_name", *[F.col(c).alias(f"_{mark}{c}") for c in ("_t", "_keys", "_often", "_rare")], F.explode("_rare").alias("_c"))
    rare = side(facts, "l").join(as_large(side(dims, "r")), ["database_name", "_c"]).filter(F.get(F.array_intersect("_l_rare", "_r_rare"), F.lit(0)) == F.col("_c"))

    if counted:
        sets = lambda df: df.groupBy("database_name", "_often").agg(F.count(F.lit(1)).alias("_v")).withColumn("_u", F.col("_often"))
        total = F.aggregate("_rv", F.lit(0).cast("bigint"), lambda a, n: a + n)
        often = _meet(sets(facts), sets(dims)).groupBy("database_name", "_often").agg(F.sum(total).alias("_n"))
        alone = rare.filter(F.size(F.array_intersect("_l_often", "_r_often")) == 0).groupBy("database_name", F.col("_l_t").alias("_t")).agg(F.count(F.lit(1)).alias("_m"))
        pairs = F.coalesce("_n", F.lit(0)) + F.coalesce("_m", F.lit(0))
        found = facts.select("database_name", "_t", "_often").join(as_large(often), ["database_name", "_often"], "left").join(as_large(alone), ["database_name", "_t"], "left")
        return found.select("database_name", F.lower("_t").alias("left_table"), pairs.alias("pairs")).filter("pairs > 0")

    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.xxhash64(c).bitwiseAND(63).cast("int"))
    bits = F.aggregate("_rare", F.lit(0).cast("bigint"), lambda a, c: a.bitwiseOR(bit(c)))  # tell most pairs without a shared rare key
    member = F.struct(F.lower("_t").alias("t"), "_rare", bits.alias("bits"))
    named = lambda df: df.select("database_name", "_often", F.col("_t").alias("_u"), member.alias("_v"))
    left, right = F.col("left_table"), F.col("right_table")
    pair = lambda df: df.select("database_name", F.concat(left, F.lit("_to_"), right).alias("name"), left, right, "relationship_columns")
    text = lambda keys: F.array_join(F.slice(keys, 1, keys_per_pair), ",").alias("relationship_columns")
    one = _meet(named(facts), named(dims)).select("database_name", text("_shared"), F.explode("_lv").alias("_l"), "_rv")
    met = one.select("database_name", "relationship_columns", "_l", F.explode("_rv").alias("_r"))
    apart = (F.col("_l.bits").bitwiseAND(F.col("_r.bits")) == 0) | ~F.arrays_overlap("_l._rare", "_r._rare")
    often = met.filter(apart).select("database_name", F.col("_l.t").alias("left_table"), F.col("_r.t").alias("right_table"), "relationship_columns")
    listed = rare.select("database_name", F.lower("_l_t").alias("left_table"), F.lower("_r_t").alias("right_table"), text(F.array_intersect("_l_keys", "_r_keys")))
    return pair(often).unionByName(pair(listed))
