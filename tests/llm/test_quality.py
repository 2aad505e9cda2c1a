import math

import numpy as np
import pytest
from plain import SF, base_statistics

from ledgerlens.functions.distributions import chi2_cdf, chi2_quantile
from ledgerlens.llm import quality as Q


def test_base_statistics(spark, documents):
    odd = ["", None, "a b c a b c", "a b c d a b c", "x\n\n x\nx\n \t \nx", "#*$%&|<> a|b", "\x0b a \x0c b\r c", "w " * 49, "a b " * 30, "é 中文   x"]
    docs = [*((10_000 + i, t, "en", "s") for i, t in enumerate(odd)), *documents]
    got = {r["doc_id"]: r for r in Q.base_statistics(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    for d, t, *_ in docs:
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_statistics(t)[:6], d


def plain_verdicts(stats):
    """stats: {doc_id: (group, language, base_failed, x, v)} -> {doc_id: (kept, squared distance)}, by whole matrices and weights of rows."""
    fit = [d for d in stats if not stats[d][2]]
    group = np.array([str(stats[d][0]) for d in fit])
    lang_of = {str(g): lang for g, lang, *_ in stats.values()}
    x, v = (np.array([stats[d][k] for d in fit]) for k in (3, 4))
    names = sorted(set(group))
    floor = {g: v[group == g].mean(0) for g in names}
    grow = Q.SHARE / chi2_cdf(chi2_quantile(Q.SHARE, Q.P), Q.P + 2)

    def lifted(cov, least):
        """The matrix whose conditional variances are those of cov, but no less than `least`, and the sum of their logarithms."""
        left, out, logdet = cov.copy(), np.zeros_like(cov), 0.0
        for j in range(Q.P):
            g = max(left[j, j], least[j])
            column = left[:, j] / g
            column[:j], column[j] = 0, 1
            out += g * np.outer(column, column)
            left = left - g * np.outer(column, column)
            logdet += math.log(g)
        return out, logdet

    def distance(rows, m, cov):
        return np.einsum("ij,ij->i", rows - m, np.linalg.solve(cov, (rows - m).T).T)

    ends, target = [], None
    for start in range(3):
        now = {}
        for g in names:
            own = x[group == g]
            cell = np.sort(np.floor(own * Q.FINE), axis=0)
            at = lambda q: cell[math.ceil(q * len(cell)) - 1]  # noqa: B023, E731
            m = (at(0.5) + 0.5) / Q.FINE
            scale = np.maximum((at(0.75) - at(0.25)) / Q.FINE / 1.349, np.sqrt(floor[g]))
            z = (own - m) / scale
            if start == 0:
                corr = np.eye(Q.P)
            else:
                y = np.tanh(z) if start == 1 else z / np.maximum(np.linalg.norm(z, axis=1), 1e-300)[:, None]
                own_scale = np.sqrt((y * y).sum(0))
                corr = y.T @ y / np.maximum(np.outer(own_scale, own_scale), 1e-300)
                np.fill_diagonal(corr, 1)
            now[g] = (m, lifted(corr * np.outer(scale, scale), floor[g])[0], math.inf)
        for _ in range(Q.STEPS):
            moments = {}
            for g in names:
                own = x[group == g]
                cell = np.floor(np.log1p(distance(own, *now[g][:2])) * Q.SLICES)
                weight = np.zeros(len(own))
                for c in sorted(set(cell)):
                    room = Q.SHARE * len(own) - weight.sum()
                    weight[cell == c] = min(1, max(0, room / (cell == c).sum()))
                moments[g] = (weight.sum(), weight @ own, (own * weight[:, None]).T @ own)

            def mixed(of, above):
                n, s, q = (sum(moments[g][k] for g in of) for k in range(3))  # noqa: B023
                m, cov = s / n, q / n - np.outer(s / n, s / n)
                w = n / (n + Q.PRIOR)
                return (m, cov) if above is None else (w * m + (1 - w) * above[0], w * cov + (1 - w) * above[1])

            if target is None:
                every = mixed(names, None)
                target = {lang: mixed([g for g in names if lang_of[g] == lang], every) for lang in set(lang_of[g] for g in names)}
            fell = False
            for g in names:
                m, cov = mixed([g], target[lang_of[g]])
                cov, logdet = lifted(cov * grow, floor[g])
                if logdet < now[g][2] - 1e-6:
                    now[g], fell = (m, cov, logdet), True
            if not fell:
                break
        ends.append(now)
    best = {g: min((e[g] for e in ends), key=lambda e: e[2]) for g in names}
    limit, out = chi2_quantile(Q.CUTOFF, Q.P), {}
    for d, (g, _, failed, own, _) in stats.items():
        d2 = distance(np.array([own]), *best[str(g)][:2])[0] if str(g) in best else None
        out[d] = (not failed and d2 <= limit, d2)
    return out


def described(docs):
    """docs: (doc_id, text, lang, source) -> what `plain_verdicts` takes."""
    out = {}
    for d, t, lang, source in docs:
        n, chars, sym, dup, rep, failed, lines = base_statistics(t)
        n1, c1, l1 = max(n, 1), max(chars, 1), max(lines, 1)
        x = (math.log1p(n), math.log1p(chars / n1), math.sqrt(sym / c1), math.sqrt(dup / l1), math.sqrt(rep / n1))
        out[d] = ((lang, source), lang, failed, np.round(x, 6), np.array((1 / n1, 1 / n1, 1 / (4 * c1), 1 / (4 * l1), 6 / (4 * n1))))
    return out


@pytest.fixture(scope="module")
def table():
    from oracle import connect

    con = connect("/root/testdata/sf0.01")
    rows = con.execute("SELECT doc_id, text, lang, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN 'big' END FROM documents").fetchall()
    return rows


def agree(got, want):
    assert len(got) == len(want)
    limit = chi2_quantile(Q.CUTOFF, Q.P)
    for d, (kept, v) in want.items():
        if v is None:
            assert got[d]["d2"] is None
        else:
            assert math.isclose(got[d]["d2"], v, rel_tol=1e-3, abs_tol=1e-4), d
            if abs(v - limit) < 0.05:
                continue
        assert got[d]["kept"] == kept, d


def test_verdicts_against_numpy(spark, table):
    got = {r["doc_id"]: r for r in Q.judge(spark.createDataFrame(table, "doc_id long, text string, lang string, source string")).collect()}
    agree(got, plain_verdicts(described(table)))


def test_the_estimate_decides(spark, monkeypatch):
    """Word lengths that go with the number of words: only the covariance of the nearest shows which texts are off that line."""
    r = np.random.default_rng(3)
    rows, stats = [], {}
    for i in range(600):
        n = int(np.exp(r.normal(6, 0.8))) + 50
        off = i % 20 == 0
        mean = math.exp(1.8 + 0.3 * (math.log(n) - 6) * (-1 if off else 1) + r.normal(0, 0.02))
        chars = round(n * mean)
        rows.append((i, "en", "s" if i % 2 else "t", n, chars, 0, 0, 0, False, 10))
        x = (math.log1p(n), math.log1p(chars / n), 0, 0, 0)
        stats[i] = (("en", "s" if i % 2 else "t"), "en", False, np.round(x, 6), np.array((1 / n, 1 / n, 1 / (4 * chars), 1 / 40, 6 / (4 * n))))
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, _n_lines int")
    whole = {x["doc_id"]: x for x in Q.verdicts(df).collect()}
    agree(whole, plain_verdicts(stats))
    monkeypatch.setattr(Q, "STEPS", 0)
    medians = {x["doc_id"]: x["kept"] for x in Q.verdicts(df).collect()}
    far = [i for i in range(0, 600, 20) if abs(math.log(rows[i][3]) - 6) > 0.8]
    assert len(far) > 5
    assert not any(whole[i]["kept"] for i in far)
    assert sum(medians[i] for i in far) > len(far) / 2
    assert sum(whole[i]["kept"] for i in range(600) if i % 20) > 560


@pytest.mark.parametrize("others", [3, 60])
def test_small_groups_are_judged_as_large_ones(spark, others):
    """One text full of symbols goes, beside however many of its own source."""
    r = np.random.default_rng(0)
    text = lambda n: " ".join("".join(r.choice(list("abcdefgh"), size=r.integers(2, 9))) for _ in range(n))
    docs = [(i, text(int(r.integers(80, 400))), "en", "s" if i < others else "t") for i in range(100)]
    docs.append((500, " ".join(w + "#$%&|<>*" * 3 for w in text(200).split()), "en", "s"))
    got = {x["doc_id"]: x["kept"] for x in Q.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[500]
    assert sum(got.values()) >= 98


def test_outliers_go_and_plain_texts_stay(spark):
    r = np.random.default_rng(0)
    text = lambda n: " ".join("".join(r.choice(list("abcdefgh"), size=r.integers(2, 9))) for _ in range(n))
    docs = [(i, text(int(r.integers(80, 400))), "en", "s") for i in range(120)]
    docs += [(500, " ".join(w + "#$%&|<>*" * 3 for w in text(200).split()), "en", "s")]
    got = {x["doc_id"]: x["kept"] for x in Q.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[500]
    assert sum(got.values()) >= 119


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, kept string, d2 int"
    df = spark.createDataFrame([(1, None, None, None, "x", 1), (1, None, None, None, "x", 1), (None, "a " * 60, "en", None, "x", 1)], schema)
    got = Q.judge(df).collect()
    assert sorted((r["doc_id"], r["base_failed"], r["kept"]) for r in got if r["doc_id"]) == [(1, True, False)] * 2
    assert Q.judge(df.limit(0)).count() == 0
    assert Q.passing(df).columns == df.columns
    long = spark.createDataFrame([(2, "one two three four " * 100_000, "en", "s")], "doc_id long, text string, lang string, source string")
    assert Q.judge(long).first()["base_failed"]


def test_query(spark):
    assert Q.op5_quality_rules(spark, SF).count() == 200
