"""Text functions: names, cleaning, source ids, diagnostics, tolerant JSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.ship import ship

#: White space as raw text has it, beyond U+0020.
WIDE_SPACE = r"(?U)\s"


def _fold(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKD")


def decomposed(column: Column) -> Column:
    """Compatibility decomposition. Only texts with non-ASCII characters go through Python."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)
    fold = F.pandas_udf(_fold, "string")
    plain = column.rlike(r"^\p{ASCII}*$")
    return F.when(plain, column).otherwise(fold(F.when(~plain, column)))


def normalize_name(column: Column) -> Column:
    """Lower case, accents dropped, other characters than a-z and 0-9 to single spaces; null to empty."""
    bare = F.regexp_replace(decomposed(F.lower(F.coalesce(column, F.lit("")))), r"[̀-ͯ]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9 ]+", " "), " +", " "))


def dehyphenate(column: Column) -> Column:
    """Joins words that a line break split, and drops carriage returns."""
    return F.regexp_replace(F.regexp_replace(column, "\r", ""), r"([A-Za-z])-\n([a-z])", "$1$2")


def paragraphs(column: Column, breaks: str = r"\n{2,}") -> Column:
    """Array of non-empty paragraphs, inner line breaks and runs of blanks folded to one space."""
    parts = F.split(dehyphenate(column), breaks)
    folded = F.transform(
        parts,
        lambda p: F.regexp_replace(
            F.regexp_replace(F.regexp_replace(p, "\n", " "), "[ \t]{2,}", " "), rf"^{WIDE_SPACE}+|{WIDE_SPACE}+$", ""
        ),
    )
    return F.filter(folded, lambda p: p != "")


def source_id(name: Column, rules: list[tuple[str, str]]) -> Column:
    """The id of the first rule whose pattern the lower-cased file name has; else a slug of at most 40 characters."""
    slug = F.substring(F.lower(F.regexp_replace(F.regexp_replace(name, r"\.pdf$", ""), "[^A-Za-z0-9]+", "-")), 1, 40)
    out = None
    for pattern, value in rules:
        hit = F.lower(name).rlike(pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return slug if out is None else out.otherwise(slug)


def sample_at(column: Column, fraction: float, length: int = 900) -> Column:
    """`length` characters from a fraction of the text on."""
    return F.substring(column, F.floor(F.length(column) * fraction).cast("int") + 1, F.lit(length))


def chars_per_page(text: Column, pages: Column) -> Column:
    """Characters a page, white space folded, halves rounded up; no pages count as one."""
    folded = F.length(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.floor(folded / F.coalesce(F.nullif(pages, F.lit(0)), F.lit(1)) + 0.5).cast("long")


def scan_verdict(per_page: Column) -> Column:
    return F.when(per_page >= 800, "TEXT").when(per_page >= 100, "PARTIAL").otherwise("SCANNED")


def scan_report(scans: DataFrame) -> DataFrame:
    """(file, num_pages, per_page, verdict, any_scanned) of (file, text, num_pages); a file that could not be read has the verdict ERROR."""
    per_page = chars_per_page(F.col("text"), F.col("num_pages"))
    rows = scans.select(
        "file",
        "num_pages",
        per_page.alias("per_page"),
        F.when(F.col("text").isNull(), "ERROR").otherwise(scan_verdict(per_page)).alias("verdict"),
    )
    some = rows.agg(F.coalesce(F.bool_or(F.col("verdict") == "SCANNED"), F.lit(False)).alias("any_scanned"))
    return rows.join(F.broadcast(some))  # one row


def authorized(header: Column, token: str | None) -> Column:
    """STRUCT<ok, reason> of an authorization header: anything goes without a token, else exactly `Bearer <token>`."""
    if not token:
        return F.struct(F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason"))
    bearer = F.coalesce(header, F.lit("")).startswith("Bearer ")
    ok = bearer & (F.substring(header, F.lit(8), F.length(header)) == F.lit(token))
    return F.struct(ok.alias("ok"), F.when(~bearer, "missing bearer token").when(~ok, "invalid token").alias("reason"))


def parse_json_array(column: Column, element: str) -> Column:
    """The array between the first `[` and the last `]`; anything else is an empty array."""
    body = F.regexp_extract(column, r"(?s)\[.*\]", 0)
    return F.coalesce(F.from_json(body, f"array<{element}>"), F.expr(f"cast(array() as array<{element}>)"))


def sql_quote(column: Column) -> Column:
    """A SQL string literal; null and empty become NULL."""
    return F.when(F.coalesce(column, F.lit("")) == "", "NULL").otherwise(F.concat(F.lit("'"), F.replace(column, F.lit("'"), F.lit("''")), F.lit("'")))


def list_join(items: Column) -> Column:
    """`a`, `a and b`, `a, b, and c`; an empty array gives an empty string."""
    n = F.size(items)
    many = F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(items, -1))
    return F.when(n <= 0, "").when(n == 1, F.get(items, F.lit(0))).when(n == 2, F.array_join(items, " and ")).otherwise(many)


def page_text(html: Column) -> Column:
    """The visible text of a raw web page: scripts, styles and tags dropped, blanks folded."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
