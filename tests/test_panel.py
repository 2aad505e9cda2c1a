import math

import numpy as np
import pytest

from ledgerlens.functions import distributions as D
from ledgerlens.operators import panel


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(3)
    rows = []
    for firm in range(40):
        a = r.normal()
        for year in range(6):
            if r.random() < 0.85:
                x = r.normal(size=2) + a / 2
                rows.append((firm, 2000 + year, float(a + 0.3 * year + x @ [1.0, -0.5] + r.normal() / 2), float(x[0]), float(x[1]), float(r.random() < 0.3 + 0.1 * (x[0] > 0)), float(r.integers(1, 5)), float(firm % 3 == 0)))
    return rows


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame([*data, (1, 2000, None, 1.0, 1.0, 0.0, 1.0, 0.0)], "firm long, year int, y double, x1 double, x2 double, t double, w double, z double").cache()


def design(data, firms=True, years=True):
    a = np.array(data)
    cols = [a[:, 3], a[:, 4]]
    if firms:
        cols += [(a[:, 0] == f).astype(float) for f in np.unique(a[:, 0])]
    if years:
        cols += [(a[:, 1] == v).astype(float) for v in np.unique(a[:, 1])[1:]]
    return np.column_stack(cols), a[:, 2], a


def lsdv(x, y, w=None):
    w = np.ones(len(y)) if w is None else w
    xw = x * np.sqrt(w)[:, None]
    b, *_ = np.linalg.lstsq(xw, y * np.sqrt(w), rcond=None)
    e = y - x @ b
    rss = float((w * e * e).sum())
    return b, rss, np.linalg.pinv(xw.T @ xw), e


def test_ols(df, data):
    a = np.array(data)
    x = np.column_stack([np.ones(len(a)), a[:, 3], a[:, 4]])
    b, rss, inv, _ = lsdv(x, a[:, 2])
    fit = panel.ols(df, "y", ["x1", "x2"])
    np.testing.assert_allclose(fit.estimate, b, atol=1e-9)
    np.testing.assert_allclose(fit.cov, inv * rss / (len(a) - 3), atol=1e-9)
    assert fit.n == len(a)
    r2 = 1 - rss / ((a[:, 2] - a[:, 2].mean()) ** 2).sum()
    assert math.isclose(fit.statistics()["r2"], r2, rel_tol=1e-9)
    assert len(fit.table(df.sparkSession).collect()) == 3


def test_vif(df, data):
    a = np.array(data)
    c = np.corrcoef(a[:, 3], a[:, 4])[0, 1]
    assert all(math.isclose(v, 1 / (1 - c * c), rel_tol=1e-9) for v in panel.vif(df.na.drop(), ["x1", "x2"]).values())


@pytest.mark.parametrize("time", [None, "year"])
def test_fixed_effects_are_those_of_dummies(df, data, time):
    x, y, a = design(data, years=time is not None)
    b, rss, inv, _ = lsdv(x, y)
    fit = panel.fixed_effects(df, "y", ["x1", "x2"], "firm", time)
    np.testing.assert_allclose(fit.estimate, b[:2], atol=1e-8)
    assert fit.df == len(y) - x.shape[1]
    np.testing.assert_allclose(fit.cov, inv[:2, :2] * rss / fit.df, atol=1e-8)


def test_clustered_errors(df, data):
    x, y, a = design(data, years=False)
    b, _, inv, e = lsdv(x, y)
    xd = x[:, :2] - np.array([x[a[:, 0] == f, :2].mean(0) for f in a[:, 0]])
    scores = np.array([(xd[a[:, 0] == f] * e[a[:, 0] == f][:, None]).sum(0) for f in np.unique(a[:, 0])])
    bread = np.linalg.inv(xd.T @ xd)
    fit = panel.fixed_effects(df, "y", ["x1", "x2"], "firm", cluster="firm")
    np.testing.assert_allclose(fit.cov, bread @ scores.T @ scores @ bread, atol=1e-9)


def test_weighted_panel(df, data):
    a = np.array(data)
    firms, n = np.unique(a[:, 0], return_counts=True)
    own = [r for r in data if r[0] in set(firms[n > 1])]
    x, y, a = design(own)
    b, rss, _, _ = lsdv(x, y, a[:, 6])
    fit = panel.weighted_panel(df, "y", ["x1", "x2"], "firm", "year", "w")
    np.testing.assert_allclose(fit.estimate, b[:2], atol=1e-8)
    m = (a[:, 6] * a[:, 2]).sum() / a[:, 6].sum()
    assert math.isclose(fit.r2, 1 - rss / (a[:, 6] * (a[:, 2] - m) ** 2).sum(), rel_tol=1e-8)


def test_random_effects_and_hausman(df):
    fixed = panel.fixed_effects(df, "y", ["x1", "x2"], "firm")
    random = panel.random_effects(df, "y", ["x1", "x2", "z"], "firm")
    assert random.terms == ["(Intercept)", "x1", "x2", "z"]
    assert abs(random.estimate[1] - 1) < 0.3
    h = panel.hausman(fixed, random)
    assert h["df"] == 2
    assert 0 <= h["p"] <= 1


def test_entropy_balance(df):
    own = panel.entropy_weights(df, "t", ["x1", "x2"]).toPandas()
    t, c = own[own.t == 1], own[own.t == 0]
    for x in ("x1", "x2"):
        assert math.isclose(np.average(c[x], weights=c.weight), t[x].mean(), abs_tol=1e-6)
    assert math.isclose(c.weight.sum(), len(t), rel_tol=1e-6)
    assert panel.entropy_balanced(df, "y", "t", ["x1", "x2"]).terms[1] == "t"


def test_entropy_balance_that_cannot_be(spark):
    far = spark.createDataFrame([(1.0, 9.0), (1.0, 8.0), (0.0, 1.0), (0.0, 2.0)], "t double, x double")
    with pytest.raises(ValueError, match="controls"):
        panel.entropy_weights(far, "t", ["x"])


def test_winsorise(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    got = sorted(r["x_win"] for r in panel.winsorise(df, ["x"], 0.05).collect())
    assert (got[0], got[-1]) == (5.0, 95.0)


def test_distributions():
    assert math.isclose(D.chi2_sf(26.432, 3), 7.746e-06, rel_tol=1e-3)
    assert math.isclose(D.t_sf2(1.959964, 1e7), 0.05, rel_tol=1e-4)
    assert math.isclose(D.f_sf(3.0, 2, 10), 0.0954, rel_tol=1e-2)
    assert math.isclose(D.chi2_cdf(D.chi2_quantile(0.9, 5), 5), 0.9, rel_tol=1e-9)


def test_published_figures_agree_with_each_other():
    f = (0.161 / 5) / ((1 - 0.161) / 1437)
    assert abs(f - 55.064) < 0.5
    assert abs(1 - (1 - 0.006) * 1442 / 1058 - -0.355) < 0.001
