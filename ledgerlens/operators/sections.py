"""Finding a sustainability section in the pages of a report.

pages: doc_id, page_num (int, from 0), text. Pattern banks are ordered: the first pattern that matches a page counts.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import any_pattern, lines, lines_with, numbered_titles, stripped
from ..sources.staging import staged

CONTEXT_BEFORE, CONTEXT_AFTER = 10, 19


def _any_literal(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def page_matches(text: Column, patterns: Sequence[str] = tuple(V.SECTION_PATTERNS.values())) -> Column:
    """The simple detector: any heading of the bank, or words that stand together on pages of the form's tables."""
    principle = text.contains("Principle") & _any_literal(text, ["Page", "Parameter"])
    named = text.contains("BRSR") & _any_literal(text, ["Table", "Indicator"])
    return F.coalesce(any_pattern(text, patterns) | principle | named, F.lit(False))


def with_neighbours(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """hits: doc_id, page_num; sizes: doc_id, n_pages. The hits with the pages before and after them, within the document, each once."""
    p = F.col("page_num")
    near = hits.select("doc_id", F.explode(F.array(p - 1, p, p + 1)).alias("page_num")).distinct()
    return near.join(sizes, "doc_id").filter((F.col("page_num") >= 0) & (F.col("page_num") < F.col("n_pages"))).select("doc_id", "page_num")


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg((F.max("page_num") + 1).alias("n_pages"))


def first_frames(pages: DataFrame, patterns: Mapping[str, str] = V.SECTION_PATTERNS, before: int = CONTEXT_BEFORE, after: int = CONTEXT_AFTER) -> DataFrame:
    """doc_id, pattern, line, context: for each pattern the first line of a document that matches it, with the lines around it."""
    whole = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_num", "text"))).alias("own"))
    own = whole.select("doc_id", lines(F.array_join(F.transform("own", lambda p: F.coalesce(p["text"], F.lit(""))), "")).alias("all"))

    def first(name: str, pattern: str) -> Column:
        hit = F.array_position(F.transform("all", lambda x: x.rlike(f"(?id){pattern}")), True) - 1
        return F.struct(F.lit(name).alias("pattern"), hit.cast("int").alias("line"))

    found = own.select("doc_id", "all", F.explode(F.array(*(first(k, p) for k, p in patterns.items()))).alias("hit")).filter("hit.line >= 0")
    start = F.greatest(F.col("hit.line") - before, F.lit(0))
    return found.select("doc_id", "hit.pattern", "hit.line", F.array_join(F.slice("all", start + 1, F.col("hit.line") + after + 1 - start), "\n").alias("context"))


# --- the detector that learns from a template


def template_structure(template: DataFrame) -> DataFrame:
    """template: page_num, text. One row: principles, sections (arrays of number and title), keywords, table_headers."""
    whole = template.agg(F.sort_array(F.collect_list(F.struct("page_num", "text"))).alias("own"))
    text = F.array_join(F.transform("own", lambda p: p["text"]), "")
    own = whole.select(text.alias("text"))
    t = F.col("text")
    return own.select(
        numbered_titles(t, "Principle", r"\d+").alias("principles"),
        numbered_titles(t, "Section", "[A-C]").alias("sections"),
        lines_with(t, ["indicator", "parameter", "disclosure", "response"]).alias("keywords"),
        F.transform(F.filter(lines(t), lambda x: x.contains("|") | F.lower(x).contains("table")), stripped).alias("table_headers"),
    )


def template_profile(template: DataFrame) -> DataFrame:
    """template_pages, has_principles, has_sections, sample_patterns: what the pages of a template that belong to the form are like."""
    own = template.select("page_num", "text", F.col("text").rlike(r"(?i)Principle\s*[1-9]").alias("p"), F.col("text").rlike(r"(?i)Section\s*[ABC]").alias("s")).filter("p or s")
    hit = lambda x: (F.length(stripped(x)) > 20) & _any_literal(x, ["Principle", "Section", "Indicator"])
    sample = F.transform(F.filter(F.slice(lines("text"), 1, 50), hit), stripped)
    first = F.slice(F.sort_array(F.collect_list(F.struct("page_num", sample.alias("own")))), 1, 3)
    # a template is one short document
    return own.agg(F.count("*").alias("template_pages"), F.coalesce(F.bool_or("p"), F.lit(False)).alias("has_principles"), F.coalesce(F.bool_or("s"), F.lit(False)).alias("has_sections"), F.flatten(F.transform(first, lambda x: x["own"])).alias("sample_patterns"))


def pattern_bank(structure: Mapping | None = None) -> dict[str, str]:
    """The ordered bank: a template's headings, the two main names, at most ten keywords. None: the default headings.

    structure: principles and sections as (number, title) pairs, keywords. Of equal names the last one's pattern holds.
    """
    bank: dict[str, str] = {}
    if structure is None:
        bank |= {f"Principle_{i}": rf"Principle\s*{i}[:\s-]" for i in range(1, 10)}
        bank |= {f"Section_{s}": rf"Section\s*{s}[:\s-]" for s in "ABC"}
        keywords = V.DEFAULT_KEYWORDS
    else:
        for kind in ("Principle", "Section"):
            for number, title in structure[f"{kind.lower()}s"]:
                bank[f"{kind}_{number}"] = rf"{kind}\s*{number}[:\s-]+{re.escape(title[:50])}"
        keywords = structure["keywords"]
    bank |= V.MAIN_PATTERNS
    for k in keywords[:10]:
        bank[f"Keyword_{k[:20]}"] = re.escape(k)
    return bank


def typed_pages(pages: DataFrame, bank: Mapping[str, str] | None = None) -> DataFrame:
    """doc_id, page_num, hit, strong, weak: does a page belong to the section, and what does it say about the report's type?

    strong: by the name of the first pattern of the bank that matches, or by the literals of the two forms, which come
    after it and so count more. weak: by the context of a numbered principle, where nothing else is known.
    """
    bank = pattern_bank() if bank is None else bank
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.coalesce(*(F.when(text.rlike(f"(?id){p}"), F.lit(k)) for k, p in bank.items()))
    own = pages.select("doc_id", "page_num", text.alias("text"), name.alias("name"))
    t = F.col("text")
    numbered, section = t.rlike(r"(?i)Principle\s*[1-9][:\s-]"), t.rlike(r"(?i)Section\s*[ABC][:\s-]")
    # fixed values: what names the two forms, and the words of their tables
    literal = _any_literal(t, ["BRSR", "Business Responsibility and Sustainability", "BRR", "Business Responsibility Report"])
    table = _any_literal(t, ["Parameter", "Disclosure", "Response", "Page Reference"]) & _any_literal(t, [f"Principle {i}" for i in range(1, 10)])
    of_name = F.when(F.col("name").contains("BRSR"), "BRSR").when(F.col("name").contains("BRR"), "BRR")
    of_literal = F.when(literal, F.when(_any_literal(t, ["BRSR", "Sustainability"]), "BRSR").otherwise("BRR"))
    weak = F.when(numbered, F.when(_any_literal(t, ["Sustainability", "ESG"]), "BRSR").otherwise("BRR"))
    hit = F.col("name").isNotNull() | numbered | section | literal | table
    return own.select("doc_id", "page_num", hit.alias("hit"), F.coalesce(of_literal, of_name).alias("strong"), weak.alias("weak"))


def report_types(typed: DataFrame) -> DataFrame:
    """doc_id, report_type: the last strong word, else the first weak one, else BRSR. Documents without a hit are left out."""
    page = F.col("page_num")
    strong = F.max_by("strong", F.when(F.col("strong").isNotNull(), page))
    weak = F.min_by("weak", F.when(F.col("weak").isNotNull(), page))
    return typed.filter("hit").groupBy("doc_id").agg(F.coalesce(strong, weak, F.lit("BRSR")).alias("report_type"))


def largest_block(hits: DataFrame, least: int = 2) -> DataFrame:
    """hits: doc_id, page_num. The pages of each document's longest run of neighbouring pages, the first one among equals; where no run has
    `least` pages, all hits."""
    by = Window.partitionBy("doc_id")
    island = F.col("page_num") - F.row_number().over(by.orderBy("page_num"))
    own = hits.select("doc_id", "page_num").distinct().withColumn("island", island)
    runs = own.groupBy("doc_id", "island").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    # islands are numbered upwards with their pages
    best = runs.groupBy("doc_id").agg(F.max_by("island", F.struct("n", -F.col("island"))).alias("best"))
    return own.join(best, "doc_id", "left").filter("best is null or island = best").select("doc_id", "page_num")


def extract(pages: DataFrame, bank: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, report_type, pages_extracted) for every document with a section, and its pages with one of context on either side.

    pages_extracted counts the section before context is added.
    """
    typed = staged(typed_pages(pages, bank))  # numbers and flags; read for both results
    block = largest_block(typed.filter("hit"))
    found = report_types(typed).join(block.groupBy("doc_id").agg(F.count("*").alias("pages_extracted")), "doc_id")
    return found, with_neighbours(block, page_counts(pages))


def extraction_status(files: DataFrame, found: DataFrame, company: Column, year: Column) -> DataFrame:
    """files: doc_id, file_name; found: of `extract`. The result table, one row for each file."""
    own = files.select("doc_id", "file_name", company.alias("Company Name"), year.alias("Year")).join(found, "doc_id", "left")
    hit = F.col("pages_extracted").isNotNull()
    out = F.concat(F.col("Company Name"), F.lit("_"), F.col("report_type"), F.lit("_"), F.col("Year"), F.lit(".pdf"))
    return own.select(
        "Company Name", "Year", F.col("file_name").alias("Original File"), F.coalesce("report_type", F.lit("None")).alias("Report Type"),
        F.coalesce("pages_extracted", F.lit(0)).cast("long").alias("Pages Extracted"), F.when(hit, "Success").otherwise("Not Found").alias("Extraction Status"),
        F.when(hit, out).otherwise("N/A").alias("Output File"), F.when(hit, "Yes").otherwise("No").alias("BRSR/BRR Found"),
    )


def status_summary(status: DataFrame) -> DataFrame:
    """By year and type: files with a section, and successes. Groups without a key are left out."""
    own = status.filter(F.col("Year").isNotNull() & F.col("Report Type").isNotNull())
    return own.groupBy("Year", "Report Type").agg(F.count("BRSR/BRR Found").alias("Total Files"), F.count_if(F.col("Extraction Status") == "Success").alias("Successful"))


def status_by_year(status: DataFrame) -> DataFrame:
    return status.groupBy("Year").agg(F.count_if(F.col("BRSR/BRR Found") == "Yes").alias("Found"), F.count_if(F.col("Extraction Status") == "Success").alias("Success"))


def status_by_type(status: DataFrame) -> DataFrame:
    return status.filter(F.col("BRSR/BRR Found") == "Yes").groupBy("Report Type").agg(F.count("*").alias("n"))


def status_totals(status: DataFrame) -> DataFrame:
    hit = F.count_if(F.col("BRSR/BRR Found") == "Yes")
    return status.agg(F.count("*").alias("total"), hit.alias("found"), (F.count("*") - hit).alias("missing"), F.count_if(F.col("Extraction Status") == "Success").alias("success"), F.round(F.try_divide(hit * 100, F.count("*")), 1).alias("percent"))
