"""Queries on a firm-year panel made of orders, and SQL where normal equations can be told in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel
from .inputs import table


def firm_years(spark, sf):
    """A firm is a customer, a year a year of orders, 1995 to 2001."""
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate")).filter("year between 1995 and 2001")
    by = o.groupBy(F.col("o_custkey").alias("firm"), "year").agg((F.avg("o_totalprice") / 1e5).alias("gw"), F.log(F.sum("o_totalprice")).alias("x1"), F.count("*").cast("double").alias("x2"))
    treated = ((F.col("year") >= 1998) & (F.col("firm") % 2 == 0)).cast("double")
    return by.select("firm", "year", "gw", "x1", "x2", treated.alias("treatment"), F.col("x2").alias("weight"), (F.col("firm") % 3 == 0).cast("double").alias("listed"))


PANEL_SQL = """SELECT o_custkey AS firm, year(o_orderdate) AS year, avg(o_totalprice) / 1e5 AS gw, ln(sum(o_totalprice)) AS x1, count(*)::DOUBLE AS x2, (year(o_orderdate) >= 1998 AND o_custkey % 2 = 0)::INT::DOUBLE AS treatment, count(*)::DOUBLE AS weight
    FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2001 GROUP BY o_custkey, year(o_orderdate)"""


def _rounded(df, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _estimates(fit, spark):
    return _rounded(fit.table(spark).select("term", "estimate", "std_error", "statistic"))


def _two(rows: str, intercept: bool, lost: str) -> str:
    """Least squares of gw on x1 and x2 by the normal equations of centred sums; lost: degrees of freedom beside the two."""
    more = "UNION ALL SELECT '(Intercept)', my - b1 * m1 - b2 * m2, sqrt(s2 * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)) FROM g" if intercept else ""
    return f"""WITH p AS ({PANEL_SQL}), q AS ({rows}), m AS (SELECT *, avg(gw) OVER () AS my, avg(x1) OVER () AS m1, avg(x2) OVER () AS m2 FROM q),
    a AS (SELECT count(*) AS n, min(my) AS my, min(m1) AS m1, min(m2) AS m2, sum((x1 - m1) ** 2) AS s11, sum((x2 - m2) ** 2) AS s22, sum((x1 - m1) * (x2 - m2)) AS s12, sum((x1 - m1) * (gw - my)) AS s1y, sum((x2 - m2) * (gw - my)) AS s2y, sum((gw - my) ** 2) AS syy, {lost} AS lost FROM m),
    f AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM a), b AS (SELECT *, (s1y * s22 - s2y * s12) / det AS b1, (s2y * s11 - s1y * s12) / det AS b2 FROM f),
    g AS (SELECT *, (syy - b1 * s1y - b2 * s2y) / (n - lost - 2) AS s2 FROM b),
    t AS (SELECT 'x1' AS term, b1 AS estimate, sqrt(s2 * s22 / det) AS std_error FROM g UNION ALL SELECT 'x2', b2, sqrt(s2 * s11 / det) FROM g {more})
    SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, round(estimate / std_error, 6) AS statistic FROM t"""


_YEARS = range(1996, 2002)
_DUMMIES = [f"d{y}" for y in _YEARS]
#: The panel with a dummy for each year but the first, and whether a firm is listed.
_PANEL = f"p AS (SELECT *, (firm % 3 = 0)::INT::DOUBLE AS listed, {', '.join(f'(year = {y})::INT::DOUBLE AS d{y}' for y in _YEARS)} FROM ({PANEL_SQL}))"


def _less_means(name: str, of: str, columns: list[str], weight: str = "1.0") -> str:
    return f"{name} AS (SELECT firm, weight, {', '.join(f'{c} - sum({weight} * {c}) OVER w / sum({weight}) OVER w AS {c}' for c in columns)} FROM {of} WINDOW w AS (PARTITION BY firm))"


def _swept(name: str, of: str, columns: list[str], by: list[str], weight: str = "1.0") -> tuple[list[str], str]:
    """Tables in which `columns` are what regressions on `by`, one after another, leave of them; the last one's name."""
    out = []
    for k, d in enumerate(by):
        rest = [f"{c} - {d} * (sum({weight} * {c} * {d}) OVER () / sum({weight} * {d} * {d}) OVER ()) AS {c}" for c in (*columns, *by[k + 1 :])]
        out.append(f"{name}{k} AS (SELECT firm, weight, {', '.join(rest)} FROM {of})")
        of = f"{name}{k}"
    return out, of


def _solved(name: str, of: str, a: str, b: str, lost: str, weight: str = "1.0") -> str:
    """One row: n, estimates b1 and b2 of gw on a and b, their inverse matrix i11.., and the variance s2 of errors; lost: degrees of freedom."""
    sums = f"SELECT count(*) AS n, {lost} AS lost, " + ", ".join(f"sum({weight} * {x} * {y}) AS {k}" for k, x, y in (("s11", a, a), ("s22", b, b), ("s12", a, b), ("s1y", a, "gw"), ("s2y", b, "gw"), ("syy", "gw", "gw")))
    return f"{name} AS (SELECT *, s11 * s22 - s12 * s12 AS det, s22 / det AS i11, s11 / det AS i22, -s12 / det AS i12, i11 * s1y + i12 * s2y AS b1, i12 * s1y + i22 * s2y AS b2, (syy - b1 * s1y - b2 * s2y) / (n - lost) AS s2 FROM ({sums} FROM {of}))"


def _sql(tables: list[str], *terms: tuple[str, str, str, str]) -> str:
    """terms: name, estimate, variance and the table that has them."""
    rows = " UNION ALL ".join(f"SELECT '{t}' AS term, {b} AS estimate, sqrt({v}) AS std_error FROM {of}" for t, b, v, of in terms)
    return f"WITH {', '.join(tables)}, t AS ({rows}) SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, round(estimate / std_error, 6) AS statistic FROM t"


def _both(one: str, two: str, of: str) -> list[tuple[str, str, str, str]]:
    return [(one, "b1", "s2 * i11", of), (two, "b2", "s2 * i22", of)]


_FIRM = [_PANEL, _less_means("q", "p", ["gw", "x1", "x2"]), _solved("f", "q", "x1", "x2", "count(DISTINCT firm) + 2")]
_SCORES = """e AS (SELECT firm, sum(x1 * (gw - b1 * x1 - b2 * x2)) AS g1, sum(x2 * (gw - b1 * x1 - b2 * x2)) AS g2 FROM q, f GROUP BY firm), m AS (SELECT sum(g1 * g1) AS m11, sum(g1 * g2) AS m12, sum(g2 * g2) AS m22 FROM e),
c AS (SELECT *, i11 * i11 * m11 + 2 * i11 * i12 * m12 + i12 * i12 * m22 AS v1, i12 * i12 * m11 + 2 * i12 * i22 * m12 + i22 * i22 * m22 AS v2 FROM f, m)"""
_CLUSTERED = _sql([*_FIRM, _SCORES], ("x1", "b1", "v1", "c"), ("x2", "b2", "v2", "c"))


def _two_way() -> str:
    swept, last = _swept("r", "q", ["gw", "x1", "x2"], _DUMMIES)
    return _sql([_PANEL, _less_means("q", "p", ["gw", "x1", "x2", *_DUMMIES]), *swept, _solved("f", last, "x1", "x2", f"count(DISTINCT firm) + {len(_DUMMIES) + 2}")], *_both("x1", "x2", "f"))


def _weighted() -> str:
    """One regressor; firms with one row are left out; errors are clustered by firm, with the correction for few clusters."""
    own = "o AS (SELECT * FROM p WHERE firm IN (SELECT firm FROM p GROUP BY firm HAVING count(*) > 1))"
    swept, last = _swept("r", "q", ["gw", "x1"], _DUMMIES, "weight")
    k = 1 + len(_DUMMIES)
    rest = f"""f AS (SELECT sum(weight * x1 * x1) AS s11, sum(weight * x1 * gw) / s11 AS b1 FROM {last}), e AS (SELECT firm, count(*) AS rows, sum(weight * x1 * (gw - b1 * x1)) AS g FROM {last}, f GROUP BY firm),
    c AS (SELECT min(b1) AS b1, sum(g * g) / min(s11) ** 2 * count(*) / (count(*) - 1) * (sum(rows) - 1) / (sum(rows) - {k}) AS v FROM e, f)"""
    return _sql([_PANEL, own, _less_means("q", "o", ["gw", "x1", *_DUMMIES], "weight"), *swept, rest], ("x1", "b1", "v", "c"))


def _random() -> list[str]:
    """Tables up to u (x1 and x2) and v (the constant and listed) of the random effects' fit, after Swamy and Arora."""
    means = "b0 AS (SELECT firm, 1.0 AS weight, count(*) AS t, 1.0 AS one, avg(gw) AS gw, avg(x1) AS x1, avg(x2) AS x2, avg(listed) AS listed FROM p GROUP BY firm)"
    between, last = _swept("b_", "b0", ["gw", "x1", "x2"], ["one", "listed"])
    theta = """h AS (SELECT f.s2 AS se, greatest(w.s2 - f.s2 / (SELECT count(*) / sum(1.0 / t) FROM b0), 0) AS su FROM f, w), k AS (SELECT firm, t, 1 - sqrt(se / (t * su + se)) AS theta FROM b0, h),
    g AS (SELECT p.firm, p.weight, 1 - theta AS one, p.gw - theta * b0.gw AS gw, p.x1 - theta * b0.x1 AS x1, p.x2 - theta * b0.x2 AS x2, p.listed - theta * b0.listed AS listed FROM p JOIN k USING (firm) JOIN b0 USING (firm))"""
    first, u = _swept("u_", "g", ["gw", "x1", "x2"], ["one", "listed"])
    second, v = _swept("v_", "g", ["gw", "one", "listed"], ["x1", "x2"])
    return [*_FIRM, means, *between, _solved("w", last, "x1", "x2", "4"), theta, *first, _solved("u", u, "x1", "x2", "4"), *second, _solved("v", v, "one", "listed", "4")]


_RANDOM = _sql(_random(), *_both("x1", "x2", "u"), *_both("(Intercept)", "listed", "v"))
#: Two terms, so that the tail of chi-square is exp(-x / 2).
_HAUSMAN = f"""WITH {', '.join(_random())}, d AS (SELECT f.b1 - u.b1 AS q1, f.b2 - u.b2 AS q2, f.s2 * f.i11 - u.s2 * u.i11 AS v11, f.s2 * f.i12 - u.s2 * u.i12 AS v12, f.s2 * f.i22 - u.s2 * u.i22 AS v22 FROM f, u),
x AS (SELECT abs(q1 * q1 * v22 - 2 * q1 * q2 * v12 + q2 * q2 * v11) / abs(v11 * v22 - v12 * v12) AS chi2 FROM d)
SELECT 'chi2' AS name, round(chi2, 5) AS value FROM x UNION ALL SELECT 'df', 2.0 UNION ALL SELECT 'p', round(exp(-chi2 / 2), 6) FROM x"""


def _balanced(steps: int = 12) -> str:
    """The weights by Newton steps on the dual, told one after another, then weighted least squares."""
    out = ["""s AS (SELECT avg(x1) FILTER (WHERE treatment = 1) AS t1, avg(x2) FILTER (WHERE treatment = 1) AS t2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, count(*) FILTER (WHERE treatment = 1) AS treated FROM p),
    z AS (SELECT p.*, (x1 - t1) / s1 AS z1, (x2 - t2) / s2 AS z2 FROM p, s), l0 AS (SELECT 0.0::DOUBLE AS l1, 0.0::DOUBLE AS l2)"""]
    for k in range(steps):
        sums = ", ".join(f"sum(e * {x}) / sum(e) AS {n}" for n, x in (("g1", "z1"), ("g2", "z2"), ("h11", "z1 * z1"), ("h12", "z1 * z2"), ("h22", "z2 * z2")))
        out.append(f"""n{k} AS (SELECT min(l1) AS l1, min(l2) AS l2, {sums} FROM (SELECT *, exp(l1 * z1 + l2 * z2) AS e FROM z, l{k} WHERE treatment = 0)),
        l{k + 1} AS (SELECT l1 - (a22 * g1 - a12 * g2) / (a11 * a22 - a12 * a12) AS l1, l2 - (a11 * g2 - a12 * g1) / (a11 * a22 - a12 * a12) AS l2 FROM (SELECT *, h11 - g1 * g1 AS a11, h12 - g1 * g2 AS a12, h22 - g2 * g2 AS a22 FROM n{k}))""")
    out.append(f"""y AS (SELECT firm, gw, x1, x2, treatment, 1.0 AS one, CASE WHEN treatment = 1 THEN 1.0 ELSE e * treated / sum(e) FILTER (WHERE treatment = 0) OVER () END AS weight FROM (SELECT *, exp(l1 * z1 + l2 * z2) AS e FROM z, s, l{steps}))""")
    first, u = _swept("u_", "y", ["gw", "x1", "x2"], ["one", "treatment"], "weight")
    second, v = _swept("v_", "y", ["gw", "one", "treatment"], ["x1", "x2"], "weight")
    return _sql([_PANEL, *out, *first, _solved("u", u, "x1", "x2", "4", "weight"), *second, _solved("v", v, "one", "treatment", "4", "weight")], *_both("x1", "x2", "u"), *_both("(Intercept)", "treatment", "v"))


_WITHIN = "SELECT firm, gw - avg(gw) OVER w AS gw, x1 - avg(x1) OVER w AS x1, x2 - avg(x2) OVER w AS x2 FROM p WINDOW w AS (PARTITION BY firm)"
_OLS = _two("SELECT * FROM p", True, "1")
_X = ["x1", "x2"]


def _balance(spark, sf):
    own = panel.entropy_weights(firm_years(spark, sf), "treatment", _X)
    return own.groupBy("treatment").agg(*(F.round(F.sum(F.col(c) * F.col("weight")) / F.sum("weight"), 5).alias(c) for c in _X), F.round(F.sum("weight"), 3).alias("total"))


def _hausman(spark, sf):
    rows = firm_years(spark, sf)
    found = panel.hausman(panel.fixed_effects(rows, "gw", _X, "firm"), panel.random_effects(rows, "gw", [*_X, "listed"], "firm"))
    digits = {"chi2": 5, "df": 0, "p": 6}
    return spark.createDataFrame(sorted((k, round(v, digits[k])) for k, v in found.items()), "name string, value double")


QUERIES = {
    "panel": (lambda s, d: _rounded(firm_years(s, d).drop("listed"), 9), f"SELECT firm, year::INT AS year, round(gw, 9) AS gw, round(x1, 9) AS x1, x2, treatment, weight FROM ({PANEL_SQL})"),
    "winsorised": (
        lambda s, d: panel.winsorise(firm_years(s, d), ["gw"], 0.05).select("firm", "year", F.round("gw_win", 9).alias("gw_win")),
        f"WITH p AS ({PANEL_SQL}), c AS (SELECT quantile_cont(gw, 0.05) AS lo, quantile_cont(gw, 0.95) AS hi FROM p) SELECT firm, year::INT AS year, round(greatest(least(gw, hi), lo), 9) AS gw_win FROM p, c",
    ),
    "ols": (lambda s, d: _estimates(panel.ols(firm_years(s, d), "gw", _X), s), _OLS),
    "vif": (lambda s, d: s.createDataFrame(sorted((k, round(v, 6)) for k, v in panel.vif(firm_years(s, d), _X).items()), "term string, vif double"), f"SELECT unnest(['x1', 'x2']) AS term, round(1 / (1 - corr(x1, x2) ** 2), 6) AS vif FROM ({PANEL_SQL})"),
    "firm_effects": (lambda s, d: _estimates(panel.fixed_effects(firm_years(s, d), "gw", _X, "firm"), s), _two(_WITHIN, False, "count(DISTINCT firm)")),
    "clustered_errors": (lambda s, d: _estimates(panel.fixed_effects(firm_years(s, d), "gw", _X, "firm", cluster="firm"), s), _CLUSTERED),
    "two_way_effects": (lambda s, d: _estimates(panel.fixed_effects(firm_years(s, d), "gw", _X, "firm", "year"), s), _two_way()),
    "random_effects": (lambda s, d: _estimates(panel.random_effects(firm_years(s, d), "gw", [*_X, "listed"], "firm"), s), _RANDOM),
    "hausman": (_hausman, _HAUSMAN),
    "weighted_panel": (lambda s, d: _estimates(panel.weighted_panel(firm_years(s, d), "gw", ["x1"], "firm", "year", "weight"), s), _weighted()),
    "entropy_balance": (
        _balance,
        f"""WITH p AS ({PANEL_SQL}) SELECT t AS treatment, round(avg(x1), 5) AS x1, round(avg(x2), 5) AS x2, round(count(*)::DOUBLE, 3) AS total FROM p, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) v(t) WHERE treatment = 1 GROUP BY t""",
    ),
    "entropy_balanced": (lambda s, d: _estimates(panel.entropy_balanced(firm_years(s, d), "gw", "treatment", _X), s), _balanced()),
    "fit_statistics": (
        lambda s, d: _rounded(panel.ols(firm_years(s, d), "gw", _X).summary(s)).filter("name in ('n', 'df', 'r2', 'adj_r2')"),
        f"""WITH p AS ({PANEL_SQL}), r AS (SELECT count(*) AS n, corr(gw, x1) AS a, corr(gw, x2) AS b, corr(x1, x2) AS c FROM p), q AS (SELECT n, (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS r2 FROM r)
        SELECT 'n' AS name, n::DOUBLE AS value FROM q UNION ALL SELECT 'df', (n - 3)::DOUBLE FROM q UNION ALL SELECT 'r2', round(r2, 6) FROM q UNION ALL SELECT 'adj_r2', round(1 - (1 - r2) * (n - 1) / (n - 3), 6) FROM q""",
    ),
}
