"""Regressions on firm-year panels.

Rows never leave the cluster: each estimator is one or two aggregations to sums of products, k x k numbers that the driver solves.
Rows with a null in any column used are left out of a fit. The number of regressors and of years is small by nature; years are
checked against a limit, because each one is a column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distributions import chi2_sf, f_sf, t_sf2
from .quantiles import quantiles

MOST_YEARS = 400


@dataclass
class Fit:
    terms: list[str]
    estimate: np.ndarray
    cov: np.ndarray
    n: int
    df: int
    rss: float
    tss: float
    tested: int  # regressors that F tests
    more: dict[str, float] = field(default_factory=dict)

    @property
    def r2(self) -> float:
        return 1 - self.rss / self.tss if self.tss else 0.0

    def rows(self) -> list[tuple]:
        out = []
        for term, b, v in zip(self.terms, self.estimate, np.diag(self.cov), strict=True):
            se = math.sqrt(max(v, 0.0))
            t = b / se if se else float("nan")
            p = t_sf2(t, self.df) if se else float("nan")
            out.append((term, float(b), se, float(t), float(p), "***" if p < 0.01 else "**" if p < 0.05 else "*" if p < 0.1 else ""))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """term, estimate, std_error, statistic, p_value, stars."""
        return spark.createDataFrame(self.rows(), "term string, estimate double, std_error double, statistic double, p_value double, stars string")

    def statistics(self) -> dict[str, float]:
        f = ((self.tss - self.rss) / self.tested) / (self.rss / self.df) if self.tested and self.rss and self.df > 0 else float("nan")
        adj = 1 - (1 - self.r2) * (self.n - 1) / self.df if self.df > 0 else float("nan")
        return {"n": float(self.n), "df": float(self.df), "r2": self.r2, "adj_r2": adj, "rse": math.sqrt(self.rss / self.df) if self.df > 0 else float("nan"), "f": f, "f_p": f_sf(f, self.tested, self.df) if f == f else float("nan")} | self.more

    def summary(self, spark: SparkSession) -> DataFrame:
        """name, value."""
        return spark.createDataFrame(sorted((k, float(v)) for k, v in self.statistics().items()), "name string, value double")


def _known(df: DataFrame, columns: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    own = df.select(*(F.col(c).cast("double").alias(c) for c in columns), *(c for c in dict.fromkeys(more) if c not in columns))
    return own.na.drop()


def _products(df: DataFrame, columns: Sequence[str | Column], weight: Column | None = None) -> tuple[int, np.ndarray]:
    """Number of rows and the matrix of (weighted) sums of products, by one aggregation."""
    c = [F.col(x) if isinstance(x, str) else x for x in columns]
    k = len(c)
    one = F.lit(1.0) if weight is None else weight
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    row = df.agg(F.count("*").alias("n"), *(F.sum(c[i] * c[j] * one).alias(f"s{i}_{j}") for i, j in pairs)).first()
    m = np.zeros((k, k))
    for i, j in pairs:
        m[i, j] = m[j, i] = row[f"s{i}_{j}"] or 0.0
    return row["n"], m


def _solve(xx: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.linalg.pinv(xx, hermitian=True)
    return inverse @ xy, inverse


def _means(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> dict[str, float]:
    of = (lambda c: F.avg(c)) if weight is None else (lambda c: F.sum(F.col(c) * F.col(weight)) / F.sum(weight))
    row = df.agg(*(of(c).alias(c) for c in columns)).first()
    return {c: row[c] or 0.0 for c in columns}


def winsorise(df: DataFrame, columns: Sequence[str], share: float = 0.01, mark: str = "_win") -> DataFrame:
    """df with {c}_win: values beyond the `share` and 1 - `share` quantiles (exact, interpolated) are set to these."""
    cuts = quantiles(df, columns, (share, 1 - share))
    return df.withColumns({c + mark: F.greatest(F.least(F.col(c).cast("double"), F.lit(cuts[c][1])), F.lit(cuts[c][0])) for c in columns})


def ols(df: DataFrame, y: str, xs: Sequence[str], weight: str | None = None) -> Fit:
    """(Weighted) least squares with a constant. Columns are centred before products are summed, so that large means cost no digits."""
    own = _known(df, [y, *xs, *([weight] if weight else [])])
    mean = _means(own, [y, *xs], weight)
    w = F.col(weight) if weight else None
    centred = [F.col(c) - F.lit(mean[c]) for c in (*xs, y)]
    n, m = _products(own, centred, w)
    k = len(xs)
    b, inverse = _solve(m[:k, :k], m[:k, k])
    tss = float(m[k, k])
    rss = max(tss - float(b @ m[:k, k]), 0.0)
    df_ = n - k - 1
    total = float(n) if weight is None else own.agg(F.sum(weight)).first()[0] or 0.0
    s2 = rss / df_ if df_ > 0 else float("nan")
    at = np.array([mean[x] for x in xs])
    cov = np.zeros((k + 1, k + 1))
    cov[1:, 1:] = inverse
    cov[0, 1:] = cov[1:, 0] = -inverse @ at
    cov[0, 0] = (1 / total if total else 0.0) + at @ inverse @ at
    return Fit(["(Intercept)", *xs], np.concatenate([[mean[y] - at @ b], b]), cov * s2, n, df_, rss, tss, k)


def vif(df: DataFrame, xs: Sequence[str]) -> dict[str, float]:
    """Variance inflation factors: the diagonal of the inverse correlation matrix."""
    own = _known(df, xs)
    mean = _means(own, xs)
    _, m = _products(own, [F.col(x) - F.lit(mean[x]) for x in xs])
    s = np.sqrt(np.diag(m))
    return dict(zip(xs, map(float, np.diag(np.linalg.inv(m / np.outer(s, s)))), strict=True))


def within(df: DataFrame, columns: Sequence[str], by: str, weight: str | None = None) -> DataFrame:
    """df with columns less their (weighted) means by `by`: an aggregate with partial sums and a join, so that no group need fit a task."""
    of = (lambda c: F.avg(c)) if weight is None else (lambda c: F.sum(F.col(c) * F.col(weight)) / F.sum(weight))
    means = df.groupBy(by).agg(*(of(c).alias(f"_m_{c}") for c in columns))
    return df.join(means, by).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*(f"_m_{c}" for c in columns))


def _fixed(df: DataFrame, y: str, xs: Sequence[str], entity: str, time: str | None, weight: str | None) -> tuple[DataFrame, list[str], int, int]:
    """Demeaned rows, with demeaned dummies of all years but the first; the dummies' names, numbers of entities and years."""
    own = _known(df, [y, *xs, *([weight] if weight else [])], [entity, *([time] if time else [])])
    dummies: list[str] = []
    years = 1
    if time:
        values = sorted(r[0] for r in own.select(time).distinct().limit(MOST_YEARS + 1).collect())
        if len(values) > MOST_YEARS:
            raise ValueError(f"{time} has over {MOST_YEARS} values: too many for dummies")
        years = len(values)
        dummies = [f"_d{i}" for i in range(1, years)]
        own = own.withColumns({d: (F.col(time) == F.lit(v)).cast("double") for d, v in zip(dummies, values[1:], strict=True)})
    n_entities = own.agg(F.count_distinct(entity)).first()[0]
    return within(own, [y, *xs, *dummies], entity, weight), dummies, n_entities, years


def fixed_effects(df: DataFrame, y: str, xs: Sequence[str], entity: str, time: str | None = None, weight: str | None = None, cluster: str | None = None, small: bool = False) -> Fit:
    """The within estimator: effects of entities, and of years if `time` is given.

    Years are dummies, demeaned by entity like all else: on unbalanced panels, demeaning by both in turn once would be wrong. cluster: a column by
    which errors may be correlated; small: its correction for few clusters.
    """
    rows, dummies, groups, years = _fixed(df, y, xs, entity, time, weight)
    k, d = len(xs), len(dummies)
    w = F.col(weight) if weight else None
    n, m = _products(rows, [*xs, *dummies, y], w)
    b, inverse = _solve(m[: k + d, : k + d], m[: k + d, -1])
    rss = max(float(m[-1, -1] - b @ m[: k + d, -1]), 0.0)
    tss = float(m[-1, -1])
    if d:
        bd, _ = _solve(m[k : k + d, k : k + d], m[k : k + d, -1])
        tss -= float(bd @ m[k : k + d, -1])
    df_ = n - groups - d - k
    cov = inverse * (rss / df_ if df_ > 0 else float("nan"))
    if cluster:
        cov = clustered(rows, y, [*xs, *dummies], b, inverse, cluster, w, n, k + d, small)
    return Fit(list(xs), b[:k], cov[:k, :k], n, df_, rss, tss, k, {"entities": float(groups), "years": float(years)})


def clustered(rows: DataFrame, y: str, xs: Sequence[str], b: np.ndarray, inverse: np.ndarray, cluster: str, weight: Column | None, n: int, k: int, small: bool) -> np.ndarray:
    """The sandwich: scores are summed by cluster, their products over clusters."""
    error = F.col(y)
    for x, v in zip(xs, b, strict=True):
        error = error - F.col(x) * F.lit(float(v))
    error = error if weight is None else error * weight
    names = [f"_g{i}" for i in range(len(xs))]
    scores = rows.groupBy(cluster).agg(*(F.sum(F.col(x) * error).alias(g) for x, g in zip(xs, names, strict=True)))
    g, meat = _products(scores, names)
    cov = inverse @ meat @ inverse
    return cov * (g / (g - 1) * (n - 1) / (n - k)) if small and g > 1 and n > k else cov


def random_effects(df: DataFrame, y: str, xs: Sequence[str], entity: str) -> Fit:
    """Feasible GLS by quasi-demeaning: the variance of errors from the within fit, that of effects from the means of entities
    (Swamy and Arora; on unbalanced panels with the harmonic mean of the entities' numbers of rows)."""
    own = _known(df, [y, *xs], [entity])
    inner = fixed_effects(own, y, _varying(own, xs, entity), entity)
    s2e = inner.rss / inner.df
    means = own.groupBy(entity).agg(*(F.avg(c).alias(c) for c in (y, *xs)), F.count("*").alias("_t"))
    between = ols(means, y, xs)
    harmonic = means.agg(F.count("*") / F.sum(1.0 / F.col("_t"))).first()[0]
    s2u = max(between.rss / between.df - s2e / harmonic, 0.0)
    theta = 1 - F.sqrt(F.lit(s2e) / (F.col("_t") * F.lit(s2u) + F.lit(s2e)))
    both = own.join(means.select(entity, "_t", *(F.col(c).alias(f"_m_{c}") for c in (y, *xs))), entity).withColumn("_theta", theta)
    quasi = both.select(*((F.col(c) - F.col("_theta") * F.col(f"_m_{c}")).alias(c) for c in (y, *xs)), (1 - F.col("_theta")).alias("_one"))
    names = ["_one", *xs]
    n, m = _products(quasi, [*names, y])
    k = len(names)
    b, inverse = _solve(m[:k, :k], m[:k, k])
    rss = max(float(m[k, k] - b @ m[:k, k]), 0.0)
    tss = float(m[k, k] - m[0, k] ** 2 / m[0, 0])
    fit = Fit(["(Intercept)", *xs], b, inverse * rss / (n - k), n, n - k, rss, tss, len(xs), {"sigma2_error": s2e, "sigma2_effect": s2u})
    fit.more["chi2"] = fit.r2 / (1 - fit.r2) * (n - k)
    return fit


def _varying(df: DataFrame, xs: Sequence[str], entity: str) -> list[str]:
    """Those of the regressors that vary within entities."""
    spread = within(df, xs, entity).agg(*(F.max(F.abs(F.col(x))).alias(x) for x in xs)).first()
    return [x for x in xs if (spread[x] or 0.0) > 1e-9]


def hausman(fixed: Fit, random: Fit) -> dict[str, float]:
    """chi2, df, p over the terms that both fits have."""
    common = [t for t in fixed.terms if t in random.terms]
    i, j = [fixed.terms.index(t) for t in common], [random.terms.index(t) for t in common]
    q = fixed.estimate[i] - random.estimate[j]
    v = fixed.cov[np.ix_(i, i)] - random.cov[np.ix_(j, j)]
    chi2 = float(abs(q @ np.linalg.pinv(v, hermitian=True) @ q))
    return {"chi2": chi2, "df": float(len(common)), "p": chi2_sf(chi2, len(common))}


def without_singletons(df: DataFrame, by: str) -> DataFrame:
    """Rows of those that occur more than once."""
    many = df.groupBy(by).agg(F.count("*").alias("_n")).filter("_n > 1").select(by)
    return df.join(many, by, "left_semi")


def weighted_panel(df: DataFrame, y: str, xs: Sequence[str], entity: str, time: str, weight: str, small: bool = True) -> Fit:
    """Weighted two-way effects with errors clustered by entity; entities with one row are left out. r2 counts the effects, within_r2 doesn't."""
    own = without_singletons(_known(df, [y, *xs, weight], [entity, time]), entity)
    fit = fixed_effects(own, y, xs, entity, time, weight, cluster=entity, small=small)
    mean = _means(own, [y], weight)[y]
    total = own.agg(F.sum(F.col(weight) * (F.col(y) - F.lit(mean)) ** 2)).first()[0]
    inner = fit.r2
    fit.tss = float(total)
    fit.more |= {"within_r2": inner, "rmse": math.sqrt(fit.rss / fit.n) if fit.n else float("nan")}
    return fit


def entropy_weights(df: DataFrame, treatment: str, xs: Sequence[str], into: str = "weight", steps: int = 60, close: float = 1e-8) -> DataFrame:
    """df with weights that give the controls (treatment 0) the means of the treated: 1 for these, exp(l x) for controls, adding up
    to the number of treated. Newton steps on the dual, each one aggregation; where the treated lie outside the controls it can't be solved."""
    own = df.na.drop(subset=[treatment, *xs])
    treated = own.filter(F.col(treatment) == 1)
    k = len(xs)
    row = treated.agg(F.count("*").alias("n"), *(F.avg(F.col(x).cast("double")).alias(f"m{i}") for i, x in enumerate(xs))).first()
    spread = own.agg(*(F.stddev_pop(F.col(x).cast("double")).alias(f"s{i}") for i, x in enumerate(xs))).first()
    z = [(F.col(x).cast("double") - F.lit(row[f"m{i}"])) / F.lit(spread[f"s{i}"] or 1.0) for i, x in enumerate(xs)]
    controls = own.filter(F.col(treatment) == 0)

    def score(at: np.ndarray) -> Column:
        out = F.lit(0.0)
        for v, x in zip(at, z, strict=True):
            out = out + F.lit(float(v)) * x
        return out

    def dual(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        w = F.exp(score(at))
        r = controls.agg(F.sum(w).alias("w"), *(F.sum(w * z[i]).alias(f"g{i}") for i in range(k)), *(F.sum(w * z[i] * z[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i + 1))).first()
        if not 0 < (r["w"] or 0.0) < math.inf:
            return math.inf, np.zeros(k), np.eye(k)
        g = np.array([r[f"g{i}"] for i in range(k)]) / r["w"]
        h = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)]) / r["w"]
        return math.log(r["w"]), g, h - np.outer(g, g)

    at = np.zeros(k)
    value, g, h = dual(at)
    for _ in range(steps):
        if np.abs(g).max() < close:
            break
        step, size = np.linalg.pinv(h, hermitian=True) @ g, 1.0
        while (new := dual(at - size * step))[0] > value and size > 1e-6:
            size /= 2
        if new[0] > value:
            break
        at, (value, g, h) = at - size * step, new
    if np.abs(g).max() > 1e-4:
        raise ValueError("entropy_weights: the controls can't be brought to the means of the treated")
    scale = row["n"] / math.exp(value)
    return own.withColumn(into, F.when(F.col(treatment) == 1, F.lit(1.0)).otherwise(F.exp(score(at)) * F.lit(scale)))


def entropy_balanced(df: DataFrame, y: str, treatment: str, xs: Sequence[str]) -> Fit:
    """Weighted least squares of y on the treatment and xs after balancing on xs."""
    return ols(entropy_weights(df, treatment, xs, "_balance"), y, [treatment, *xs], "_balance")
