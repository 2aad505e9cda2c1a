"""Page triage: which pages of a report are kept, read anew or skipped, and the cleaned text of what is kept."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.columns import bound
from ..functions.text import any_pattern, clean_tokens, stripped

DENSE, SHORT, OCR_LEAST, HEAD = 0.28, 80, 50, 800


def is_financial(text: Column, patterns: Sequence[str] = V.FINANCIAL_PATTERNS, head: int = HEAD) -> Column:
    """Do a page's first characters hold a phrase of financial statements?"""
    return any_pattern(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, head)), patterns, "(?d)")


def is_dense(text: Column, share: float = DENSE) -> Column:
    """More than `share` of the characters, but for spaces and newlines, are digits; an empty page is not dense."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(F.translate(text, " \n", ""))
    return F.when(n == 0, False).otherwise(F.regexp_count(text, F.lit(r"\p{Nd}")) / F.nullif(n, F.lit(0)) > share)


def is_landscape(width: Column, height: Column) -> Column:
    return F.coalesce(width > height, F.lit(False))


def is_short(text: Column, least: int = SHORT) -> Column:
    return F.length(stripped(F.coalesce(text, F.lit("")))) < least


def table_text(tables: Column) -> Column:
    """array<array<array<string>>>: trimmed cells joined by spaces, empty ones left out, rows joined by spaces."""
    cell = lambda c: F.coalesce(stripped(c), F.lit(""))
    row = lambda r: F.concat_ws(" ", F.filter(F.transform(r, cell), lambda c: c != ""))
    return F.concat_ws(" ", F.filter(F.transform(F.flatten(tables), row), lambda r: r != ""))


def block_text(blocks: Column) -> Column:
    """Text blocks of a landscape page, from top to bottom and left to right (array<struct<y, x, text>>), blank ones left out."""
    own = F.filter(F.transform(F.sort_array(blocks), lambda b: b["text"]), lambda t: stripped(F.coalesce(t, F.lit(""))) != "")
    return F.array_join(own, "\n")


def triage(pages: DataFrame, patterns: Sequence[str] = V.FINANCIAL_PATTERNS, share: float = DENSE, short: int = SHORT, ocr_least: int = OCR_LEAST) -> DataFrame:
    """pages: doc_id, page_num, text and, if there are any, tables, ocr (string: what recognition gives for the page). Adds action and page_text.

    In this order: financial pages are skipped; dense ones give the text of their tables and count as skipped, too; short ones give what
    was recognised, if that is longer than `ocr_least`, and are skipped otherwise; all others are kept as they are. Null texts are empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    tables = table_text(F.col("tables")) if "tables" in pages.columns else F.lit("")
    ocr = F.coalesce(F.col("ocr"), F.lit("")) if "ocr" in pages.columns else F.lit("")
    action = (
        F.when(is_financial(text, patterns), "financial")
        .when(is_dense(text, share), "table")
        .when(is_short(text, short), F.when(F.length(stripped(ocr)) > ocr_least, "ocr").otherwise("short"))
        .otherwise("text")
    )
    own = pages.withColumn("action", action)
    a = F.col("action")
    return own.withColumn("page_text", F.when(a == "text", text).when(a == "ocr", ocr).when((a == "table") & (tables != ""), tables))


def document_text(triaged: DataFrame) -> DataFrame:
    """doc_id, text, skipped_pages: pages in order, joined by an empty line; the numbers (from 1) of those skipped."""
    kept = F.collect_list(F.when(F.col("page_text").isNotNull(), F.struct("page_num", "page_text")))
    gone = F.collect_list(F.when(F.col("action").isin("financial", "table", "short"), F.col("page_num") + 1))
    by = triaged.groupBy("doc_id").agg(F.sort_array(kept).alias("kept"), F.sort_array(gone).alias("skipped_pages"))
    return by.select("doc_id", F.array_join(F.transform("kept", lambda p: p["page_text"]), "\n\n").alias("text"), "skipped_pages")


def conversion_log(triaged: DataFrame, stops: Iterable[str] = (), normalise: bool = True) -> DataFrame:
    """One row for each document: filename, status, total_tokens, skipped_pages (JSON), output_file, error, and the cleaned text.

    A document without any text is logged as empty instead of ending the run.
    """
    own = bound(document_text(triaged), tokens=clean_tokens("text", stops, normalise))
    n = F.size("tokens").cast("long")
    name = F.col("doc_id").cast("string")
    status = F.when(n > 0, "success").otherwise("empty")
    return own.select(
        name.alias("filename"), status.alias("status"), n.alias("total_tokens"), F.to_json("skipped_pages").alias("skipped_pages"),
        F.concat(name, F.lit(".txt")).alias("output_file"), F.lit(None).cast("string").alias("error"), F.array_join("tokens", " ").alias("cleaned"),
    )
