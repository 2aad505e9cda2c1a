"""Attributes of file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(name: Column) -> Column:
    """Without the last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)


def drop_prefix(name: Column) -> Column:
    """What follows the first underscore; without one the name as it is."""
    return F.regexp_replace(name, r"^[^_]*_", "")


def drop_stem_prefix(name: Column) -> Column:
    """The same on the stem alone, the suffix stays."""
    return F.concat(drop_prefix(stem(name)), suffix(name))


def safe(name: Column) -> Column:
    """Characters that file systems forbid become underscores."""
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


def company(name: Column) -> Column:
    """From 'Company_Annual Report_2021-22.pdf' and the like."""
    return F.regexp_replace(F.regexp_replace(stem(name), r"(?i)_Annual[_\s]Report.*$", ""), r"_\d{4}-\d{2}$", "")


def year(name: Column) -> Column:
    """The first 2021-22, else the first 2021, else Unknown: a string."""
    found = (F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in (r"(\d{4}-\d{2})", r"(\d{4})"))
    return F.coalesce(*found, F.lit("Unknown"))


def first_part(name: Column) -> Column:
    """The text file's company: what precedes the first underscore ('.txt' is removed wherever it stands)."""
    return F.split_part(F.replace(name, F.lit(".txt"), F.lit("")), F.lit("_"), F.lit(1))


def first_year(name: Column) -> Column:
    """The first part of exactly four digits, parts being set apart by underscores, hyphens and white space; else Unknown."""
    flat = F.translate(F.replace(name, F.lit(".txt"), F.lit("")), "_-", "  ")
    return F.coalesce(F.nullif(F.regexp_extract(flat, r"(?<!\S)(\d{4})(?!\S)", 1), F.lit("")), F.lit("Unknown"))


def ticker(symbol: Column) -> Column:
    return F.upper(F.btrim(symbol))


def without(name: Column, literal: str) -> Column:
    """The name without a literal, wherever it stands."""
    return F.replace(name, F.lit(literal), F.lit(""))


def cleaned(name: Column) -> Column:
    """The name of the cleaned text that is made of a file."""
    return F.concat(stem(name), F.lit("_cleaned.txt"))
