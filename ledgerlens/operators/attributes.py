"""Attributes of companies: year of incorporation out of reports, sector and industry out of web pages."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.columns import bound, col
from ..functions.company_html import company_fields
from ..functions.deploy import ship
from ..functions.metrics import percent
from ..functions.names import ticker as clean_ticker
from ..functions.text import first_of

INDUSTRY_COLUMNS = ["ticker", "company_name", "sector", "industry", "sub_industry", "status"]


def incorporation(docs: DataFrame, company: Column, text: str = "text", patterns: Sequence[str] = V.INCORPORATION_PATTERNS, error: str | None = None) -> DataFrame:
    """Company Name, Year of Incorporation: a year, 'Not Found', or 'Error: ...' where column `error` says that a report couldn't be read."""
    year = F.coalesce(first_of(F.coalesce(F.col(text), F.lit("")), patterns), F.lit("Not Found"))
    if error:
        year = F.when(F.col(error).isNotNull(), F.concat(F.lit("Error: "), F.col(error))).otherwise(year)
    return docs.select(company.alias("Company Name"), year.alias("Year of Incorporation"))


def incorporation_counts(found: DataFrame) -> DataFrame:
    """total; found: all but 'Not Found', errors among them; found_years: years alone; not_found."""
    y = F.col("Year of Incorporation")
    return found.agg(F.count("*").alias("total"), F.count_if(y != "Not Found").alias("found"), F.count_if(y.rlike(r"^\d{4}$")).alias("found_years"), F.count_if(y == "Not Found").alias("not_found"))


def industry(pages: DataFrame, key: Column | str = "ticker") -> DataFrame:
    """pages: key, status_code, html. INDUSTRY_COLUMNS for each row.

    Codes other than 200 and pages that can't be parsed are told in status; a null code is a failed request. HTML is parsed
    in Python, and only where there is a page.
    """
    ship(pages.sparkSession)
    own = pages.select(clean_ticker(col(key)).alias("ticker"), F.col("status_code").alias("_code"), F.when(F.col("status_code") == 200, F.coalesce("html", F.lit(""))).alias("_html"))

    def parse(html: pd.Series) -> pd.DataFrame:
        rows = []
        for h in html:
            if h is None:
                rows.append((None, None, None, None))
                continue
            try:
                rows.append(company_fields(h))
            except Exception as e:  # one page must not end the job: its row says what went wrong
                rows.append(("Not Found", "Not Found", "Not Found", f"Parse Error: {e}"))
        return pd.DataFrame(rows, columns=["company_name", "sector", "industry", "status"])

    parsed = F.pandas_udf(parse, "company_name string, sector string, industry string, status string")
    own = bound(own.withColumn("_p", parsed("_html")), _q=F.col("_p"))
    known = lambda c: F.coalesce(F.col(f"_q.{c}"), F.lit("Not Found"))
    status = F.when(F.col("_code").isNull(), "Request Error").when(F.col("_code") == 404, "Company not found").when(F.col("_code") != 200, F.concat(F.lit("HTTP Error: "), F.col("_code").cast("string"))).otherwise(F.col("_q.status"))
    return own.select("ticker", known("company_name").alias("company_name"), known("sector").alias("sector"), known("industry").alias("industry"), F.lit("Not Found").alias("sub_industry"), status.alias("status"))


def with_fallback(found: DataFrame, fallback: Iterable[tuple[str, str, str, str]] = V.FALLBACK_COMPANIES) -> DataFrame:
    """The rows found, and the others looked up in a table of (ticker, company, sector, industry), with what that gives."""
    known = found.sparkSession.createDataFrame(list(fallback), "ticker string, _company string, _sector string, _industry string")
    hit = found.filter(F.col("status") == "Found")
    rest = found.filter(~F.col("status").eqNullSafe("Found")).select("ticker").join(F.broadcast(known), "ticker", "left")
    status = F.when(F.col("_company").isNotNull(), "Found (Fallback)").otherwise("Not in fallback database")
    return hit.unionByName(rest.select("ticker", F.col("_company").alias("company_name"), F.col("_sector").alias("sector"), F.col("_industry").alias("industry"), status.alias("status")), allowMissingColumns=True)


def industry_counts(found: DataFrame) -> DataFrame:
    hit = F.count_if(F.col("status") == "Found")
    return found.agg(F.count("*").alias("total"), hit.alias("found"), F.count_if(~F.col("status").eqNullSafe("Found")).alias("not_found"), percent(hit, F.count("*")).alias("success_rate"))
