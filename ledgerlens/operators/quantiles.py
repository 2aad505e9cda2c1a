"""Exact quantiles without bringing a column into one task.

A mergeable sketch gives bounds on either side of a quantile; the rows below the bounds are counted, and only the values between them, some
thousandths of a column with equal ones counted together, are put in order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: One in so many rows is what the sketch may be off by.
ACCURACY = 10_000


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """For each column its quantiles, interpolated between neighbours; nulls don't count, of nothing else there is no quantile.

    What comes to the driver is a number for each column and share. Not-a-numbers are the largest values, as in a sort.
    """
    own = df.select(*(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)))
    near = [min(1.0, max(0.0, q + by)) for q in shares for by in (-3 / ACCURACY, 3 / ACCURACY)]
    seen = own.agg(*(F.count(f"_{i}").alias(f"n{i}") for i in range(len(columns))), *(F.percentile_approx(f"_{i}", near, F.lit(ACCURACY)).alias(f"b{i}") for i in range(len(columns)))).first()
    asked = [(i, j, seen[f"n{i}"], *seen[f"b{i}"][2 * j : 2 * j + 2]) for i in range(len(columns)) for j in range(len(shares)) if seen[f"n{i}"]]
    if not asked:
        return {c: [None] * len(shares) for c in columns}
    below = own.agg(*(F.count_if(F.col(f"_{i}") < lo).alias(f"u{i}_{j}") for i, j, _, lo, _ in asked)).first()
    at = F.array(*(F.when(F.col(f"_{i}").between(lo, hi), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_{i}").alias("v"))) for i, j, _, lo, hi in asked))
    counts = own.select(F.explode(F.filter(at, lambda x: x.isNotNull())).alias("x")).groupBy("x.i", "x.j", "x.v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("i", "j").orderBy("v"))
    ranks = {(i, j): shares[j] * (n - 1) for i, j, n, *_ in asked}
    wanted = df.sparkSession.createDataFrame([(i, j, math.floor(r) - below[f"u{i}_{j}"], math.ceil(r) - below[f"u{i}_{j}"]) for (i, j), r in ranks.items()], "i int, j int, low long, high long")
    placed = counts.withColumn("upto", upto).join(F.broadcast(wanted), ["i", "j"])  # a row for each number asked for
    first = lambda c: F.min(F.when(F.col("upto") > F.col(c), F.col("v")))
    found = {(r["i"], r["j"]): (r["a"], r["b"]) for r in placed.groupBy("i", "j").agg(first("low").alias("a"), first("high").alias("b")).collect()}
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    for (i, j), r in ranks.items():
        a, b = found[i, j]
        out[columns[i]][j] = a if math.floor(r) == math.ceil(r) else (math.ceil(r) - r) * a + (r - math.floor(r)) * b
    return out
