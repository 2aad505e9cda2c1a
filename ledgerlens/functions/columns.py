"""Helpers on columns and frames that the operators share."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(df: DataFrame, **cols: Column) -> DataFrame:
    """df with columns that are computed once a row: later filters and projections neither move below them nor repeat them."""
    return df.select(*df.columns, F.inline(F.array(F.struct(*(c.alias(k) for k, c in cols.items())))))


def one_of(words: Iterable[str]):
    """A predicate on a column: is it one of the words? (A list of more than a few becomes a hash set in the plan.)"""
    known = sorted(set(words))
    return (lambda c: c.isin(known)) if known else (lambda c: F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is zero."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)))


def rounded(c: Column, digits: int, rounding: str = "spark") -> Column:
    """rounding: 'spark' rounds half up on the shortest decimal, inside the JVM; 'python' rounds the exact binary value half to even."""
    if rounding == "spark":
        return F.round(c, digits)
    if rounding != "python":
        raise ValueError(f"rounding: spark or python, not {rounding}")

    @F.pandas_udf("double")
    def exact(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or v != v else round(float(v), digits) for v in x], dtype="float64")

    return exact(c)


def ordered(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that df has, in the order given."""
    return df.select(*(c for c in columns if c in df.columns))


def missing_from(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key `other` doesn't have, null keys among them: an anti-join."""
    return df.join(other.select(key), key, "left_anti")


def first_rows(df: DataFrame, by: str, most: int = 10) -> DataFrame:
    """The first rows by a column: a top-k, never a full sort."""
    return df.orderBy(by).limit(most)


def yes_no(flag: Column, unknown: str = "Not Found") -> Column:
    """Yes or No, and `unknown` for null."""
    return F.when(flag.isNull(), F.lit(unknown)).when(flag, F.lit("Yes")).otherwise(F.lit("No"))
