"""Word lists out of text files and master tables, in the dialects that occur."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import LETTERS, stripped, tokens


def words_of(lines: DataFrame, comments: str = ";", comment_on_raw: bool = False, first_field: bool = False, alpha_only: bool = False, column: str = "value") -> DataFrame:
    """word: the distinct entries of lines, in lower case.

    comments: characters that start a comment line; comment_on_raw: only as the line's very first character, otherwise after white
    space, too. first_field: an entry is the line's first token, otherwise the whole stripped line. alpha_only: letters alone.
    """
    raw = F.coalesce(F.col(column), F.lit(""))
    own = stripped(raw)
    head = raw if comment_on_raw else own
    comment = F.lit(False)
    for c in comments:
        comment = comment | F.startswith(head, F.lit(c))
    entry = F.lower(F.coalesce(F.get(tokens(own), F.lit(0)), F.lit("")) if first_field else own)
    found = lines.filter(~comment).select(entry.alias("word")).filter(F.col("word") != "")
    return (found.filter(F.col("word").rlike(LETTERS)) if alpha_only else found).distinct()


#: The dialects of list files.
DIALECTS = {
    "category": {"comments": ";", "first_field": True, "alpha_only": True},
    "list": {"comments": ";#", "comment_on_raw": True},
    "stopwords": {"comments": ";"},
    "inline": {"comments": "#", "comment_on_raw": True},
}


def load_words(spark: SparkSession, path: str, dialect: str = "category") -> DataFrame:
    return words_of(spark.read.text(path), **DIALECTS[dialect])


def find_column(columns: list[str], wanted: str) -> str | None:
    """The column of that name, ignoring case; else the first that holds it."""
    low = wanted.lower()
    return next((c for c in columns if c.lower() == low), next((c for c in columns if low in c.lower()), None))


def flagged(cell: Column, numeric: bool = False) -> Column:
    """Does a cell of a master table say yes? As text: neither empty nor '0' (so 0.0 and negative numbers do); numeric: other than zero."""
    own = stripped(F.coalesce(cell.cast("string"), F.lit("")))
    return F.coalesce(own.try_cast("double") != 0, F.lit(False)) if numeric else (own != "") & (own != "0")


def master_words(table: DataFrame, categories: Mapping[str, str] = V.TONE_CATEGORIES, numeric: bool = False) -> DataFrame:
    """category, word of a master table with a column of words and one of flags for each category, read once; columns that are missing give nothing."""
    word = find_column(table.columns, "Word")
    if word is None:
        raise ValueError(f"no column of words among: {', '.join(table.columns)}")
    entry = F.lower(stripped(F.col(word)))
    found = [(k, c) for k, v in categories.items() if (c := find_column(table.columns, v))]
    if not found:
        return table.select(F.lit(None).cast("string").alias("category"), entry.alias("word")).filter("false")
    flags = F.array(*(F.when(flagged(F.col(c), numeric), F.lit(k)) for k, c in found))
    return table.select(F.explode(F.array_compact(flags)).alias("category"), entry.alias("word")).filter(F.col("word").rlike(LETTERS)).distinct()


def merge(master: DataFrame | None, lists: DataFrame | None) -> DataFrame:
    """category, word: the union of both sources, each word once in a category."""
    both = [x.select("category", "word") for x in (master, lists) if x is not None]
    if not both:
        raise ValueError("merge: neither a master table nor lists")
    return (both[0] if len(both) == 1 else both[0].unionByName(both[1])).distinct()


def as_sets(lexicon: DataFrame, most: int = 500_000) -> dict[str, list[str]]:
    """A lexicon as lists by category, for predicates. More than `most` entries are refused: use the join on the table instead."""
    rows = lexicon.select("category", "word").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} entries: use category_counts with the table")
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["category"], []).append(r["word"])
    return {k: sorted(v) for k, v in out.items()}


def union_of(tables: list[DataFrame], column: str = "word") -> DataFrame:
    """word: the entries of all tables, each once, in lower case."""
    if not tables:
        raise ValueError("union_of: no tables")
    both = tables[0].select(column)
    for t in tables[1:]:
        both = both.unionAll(t.select(column))
    return both.select(F.lower(column).alias("word")).distinct()
