"""Column expressions over SQL text. Patterns stay in the subset that Java and RE2 share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_COMMENT = r"(?m)--.*?$"
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
SLASH_COMMENT = r"(?m)//.*?$"

# Statements that change data or objects.
WRITE_START = r"(?m)^\s*(UPDATE|DELETE|INSERT|DROP|ALTER|TRUNCATE|MERGE)\s+"
CREATE_TABLE = r"CREATE\s+(OR\s+REPLACE\s+)?(TEMP|TEMPORARY|VOLATILE)?\s*TABLE\s+"

TABLE_AFTER_FROM = r'(?i)(?:FROM|JOIN)\s+(["\w]+(?:\.\.?["\w]+)*)\s*(?:AS\s+)?'
ALIAS_COLUMN = (
    r"""["']?([A-Za-z_][A-Za-z0-9_]*)["']?\s*\.\s*["']?([A-Za-z_][A-Za-z0-9_]*)["']?"""
)

# Words that follow FROM or JOIN without being tables.
NOT_A_TABLE = (
    "SELECT WHERE AND OR ON GROUP ORDER HAVING LIMIT UNION CASE WHEN THEN ELSE END AS LEFT RIGHT INNER OUTER CROSS "
    "FULL LATERAL WITH RECURSIVE NOT NULL TRUE FALSE IN EXISTS"
).split()

# Names after a dot that are not columns, and a column prefix that is left out.
NOT_A_COLUMN = ("PUBLIC", "DBO", "SCHEMA", "FCT", "DIM", "ALL")
SKIPPED_COLUMN_PREFIX = "PS_PRD"

AGGREGATE_CALL = r"(?i)(SUM|COUNT|AVG|MIN|MAX|MEDIAN|STDDEV|VARIANCE)\s*\(\s*(DISTINCT\s+)?([^)]+)\)"


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip_comments(sql: str | Column) -> Column:
    """Text without line, block and slash comments; string literals are not respected."""
    text = _col(sql)
    for pattern in (LINE_COMMENT, BLOCK_COMMENT, SLASH_COMMENT):
        text = F.regexp_replace(text, pattern, "")
    return text


def is_write(sql: str | Column) -> Column:
    """Whether a statement changes data or objects, comments aside."""
    return is_write_text(strip_comments(sql))


def is_write_text(clean: str | Column) -> Column:
    """The same for a text whose comments are gone already."""
    text = F.upper(F.trim(_col(clean)))
    return text.rlike(WRITE_START) | text.rlike(CREATE_TABLE)


def normalize_table(name: str | Column) -> Column:
    """Upper-case name without quotes; an omitted schema becomes PUBLIC."""
    text = F.upper(F.replace(F.trim(_col(name)), F.lit('"'), F.lit("")))
    parts = F.split(text, r"\.\.")
    return F.when(F.size(parts) == 2, F.concat_ws(".", F.get(parts, F.lit(0)), F.lit("PUBLIC"), F.get(parts, F.lit(1)))).otherwise(text)


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def extract_tables(clean: str | Column, skip_short_prefix: str | None = "PA", short_length: int = 5) -> Column:
    """Sorted distinct tables named after FROM or JOIN in a text without comments."""
    found = F.regexp_extract_all(_col(clean), F.lit(TABLE_AFTER_FROM), 1)

    def wanted(name: Column) -> Column:
        last = last_part(name)
        keep = ~last.isin(*NOT_A_TABLE) & ~last.rlike(r"^\d+$")
        if skip_short_prefix:
            keep = keep & ~(last.startswith(skip_short_prefix) & (F.length(last) <= short_length))
        return keep

    return F.array_sort(F.array_distinct(F.filter(F.transform(found, normalize_table), wanted)))


def column_references(
    clean: str | Column, skipped: Sequence[str] = NOT_A_COLUMN, prefix: str | None = SKIPPED_COLUMN_PREFIX
) -> Column:
    """Distinct (alias, column) pairs written as alias.column in a text without comments, sorted."""
    found = F.regexp_extract_all(_col(clean), F.lit(f"({ALIAS_COLUMN})"), 1)

    def pair(match: Column) -> Column:
        parts = F.split(F.upper(F.regexp_replace(match, r"""["'\s]""", "")), r"\.")
        return F.struct(F.get(parts, F.lit(0)).alias("alias"), F.get(parts, F.lit(1)).alias("name"))

    def wanted(p: Column) -> Column:
        keep = ~p["name"].isin(*skipped)
        return keep & ~p["name"].startswith(prefix) if prefix else keep

    return F.array_sort(F.array_distinct(F.filter(F.transform(found, pair), wanted)))


def each(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """One row per element of a costly array.

    A plain explode lets the optimizer test the array for elements first, which
    computes it twice; the outer form with a test afterwards does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def normalized_text(sql: str | Column) -> Column:
    """Text with literals replaced and spaces collapsed: one value per query pattern."""
    text = F.regexp_replace(_col(sql), r"'[^']*'", "?")
    text = F.regexp_replace(text, r"\b\d+(\.\d+)?\b", "?")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def table_class(name: Column) -> Column:
    """Dimension, fact or other, by the last part of a table name."""
    last = last_part(name)
    return F.when(last.startswith("DIM_"), "dimension").when(last.startswith("FCT_"), "fact").otherwise("other")
