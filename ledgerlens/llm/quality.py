r"""Quality rules: base rules, and robust multivariate outliers by the minimum covariance determinant.

Each text is described by five statistics, transformed so that ordinary texts spread about alike: the logarithms of
its words and of its mean word length, and square roots of the shares of symbols, repeated lines and repeated words. For each
language and source, location and scatter are those of the `SHARE` of its texts whose covariance has the least determinant. They are looked for from
three deterministic starts (medians with quartile ranges alone, with the correlations of tanh scores, and with those of spatial signs;
Hubert, Rousseeuw and Verdonck 2012) by concentration steps (Rousseeuw and Van Driessen 1999) until no determinant falls any more; of the three
ends the one of the least determinant stays. A text is rejected where its squared Mahalanobis distance exceeds the chi-square quantile `CUTOFF`: one
text in a thousand of a normal group.

Small groups: every group's moments are joined by those of its language, which count as `PRIOR` texts, and these by those of all texts likewise (both of the
nearest `SHARE` of each group at the first start), so that the estimate goes over from the group's own to its language's and the corpus's as the group
gets smaller, with no threshold. Singular
directions: most texts have no symbols, no repeated lines and no repeated words, so that the best `SHARE` of a group doesn't vary there at all. The
variance of a statistic, given those before it, is therefore no less than what counting alone makes of it (`_features`).

All is sums and counts by group and slice of the distance: the slice that `SHARE` ends in counts in part. The 5 x 5 matrices are factored (L D L')
in Column expressions, so that nothing is collected, however many sources there are, and no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_cdf, chi2_quantile
from .common import SPACES, discard, small, staged, table, words

SHARE, PRIOR, CUTOFF = 0.75, 25, 0.999
#: Concentration steps at most; the 80 sources of sf0.1 need six.
STEPS = 50
#: Slices of a unit of a statistic, and of an e-fold of distances, in which rows are counted.
FINE, SLICES = 1024, 64
P = 5
#: A window found twice covers six words at least, so that repeated words come six at a time.
RUN = 6
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
SYMBOLS = "#*$%&|<>"
GROUP, LANG = "_group", "_lang"


def base_statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda t, chars: F.length(t) - F.length(F.translate(t, chars, ""))
    d = docs.withColumn("_w", words("text")).withColumn("_l", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n_words", F.size("_w").cast("long")).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    d = d.withColumn("word_chars", F.length(F.translate(text, SPACES, "")).cast("long")).withColumn("n_symbols", bare(text, SYMBOLS).cast("long"))
    word = lambda i: F.get(F.col("_w"), i)
    d = d.withColumn("_h", F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))).otherwise(F.array().cast("array<long>")))
    repeated = F.size("_h") > F.size(F.array_distinct("_h"))
    d = d.withColumn("_s", F.when(repeated, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("_at", F.sort_array(F.filter(F.transform("_s", lambda s, k: F.when(_beside(s, k), s["i"])), lambda i: i.isNotNull())))
    covered = F.aggregate("_at", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", failed).withColumn("_n_lines", F.size("_l")).drop("_w", "_l", "_h", "_s", "_at")


def _beside(s: Column, k: Column) -> Column:
    """Is the hash equal to that before or after it in the sorted array _s?"""
    before, after = F.get(F.col("_s"), k - 1), F.get(F.col("_s"), k + 1)
    return F.coalesce(s["h"] == before["h"], F.lit(False)) | F.coalesce(s["h"] == after["h"], F.lit(False))


def _features(d: DataFrame) -> DataFrame:
    """d with the statistics x0.. and v0.., the variance that each has by counting alone: 1 / n for the logarithm of a count of n (and of a mean of n words),
    1 / 4n for the square root of a share of n."""
    most = lambda c: F.greatest(F.col(c).cast("double"), F.lit(1.0))
    n, chars, n_lines = most("n_words"), most("word_chars"), most("_n_lines")
    x = (F.log1p("n_words"), F.log1p(F.col("word_chars") / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / n_lines), F.sqrt(F.col("n_repeat_words") / n))
    v = (1 / n, 1 / n, 1 / (4 * chars), 1 / (4 * n_lines), RUN / (4 * n))
    return d.withColumns({f"x{i}": F.round(c, 6) for i, c in enumerate(x)} | {f"v{i}": c for i, c in enumerate(v)})


def _grouped(d: DataFrame) -> DataFrame:
    """d with the group each row is judged in, and its language."""
    name = lambda *c: F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(x)), F.lit("-")) for x in c))
    return d.withColumn(GROUP, name("lang", "source")).withColumn(LANG, name("lang"))


def _slice_at(counts: DataFrame, by: list[str], share: float, name: str) -> DataFrame:
    """counts: by, slice, n. The first slice up to which `share` of the rows lie."""
    w = Window.partitionBy(*by)
    upto, total = F.sum("n").over(w.orderBy("slice")), F.sum("n").over(w)
    return counts.withColumn("upto", upto).withColumn("total", total).filter(F.col("upto") >= F.col("total") * share).groupBy(*by).agg(F.min("slice").alias(name))


def _once(d: DataFrame, **numbers: str) -> DataFrame:
    """d with columns that are computed once a row (see `bound`), given as SQL: of the hundreds of terms here each would be a call to the JVM."""
    return d.selectExpr("*", "inline(array(named_struct(" + ", ".join(f"'{k}', {c}" for k, c in numbers.items()) + ")))")


def _middles(fit: DataFrame) -> DataFrame:
    """For each group its medians m0.., quartile ranges as standard deviations r0.., and floors f0.. of the variances."""
    each = fit.selectExpr(GROUP, f"posexplode(array({', '.join(f'floor(x{i} * {FINE})' for i in range(P))})) as (stat, slice)")
    counts = staged(each.groupBy(GROUP, "stat", "slice").agg(F.count("*").alias("n")))
    by = [GROUP, "stat"]
    cuts = _slice_at(counts, by, 0.5, "mid").join(_slice_at(counts, by, 0.25, "low"), by).join(_slice_at(counts, by, 0.75, "high"), by)
    at = lambda i, c: f"max(case when stat = {i} then {c} end) / {FINE}D"
    cuts = cuts.groupBy(GROUP).agg(*(F.expr(f"{at(i, 'mid + 0.5D')} as m{i}") for i in range(P)), *(F.expr(f"{at(i, 'high - low')} / 1.349D as r{i}") for i in range(P)))
    floors = fit.groupBy(GROUP, LANG).agg(*(F.expr(f"round(avg(v{i}), 12) as f{i}") for i in range(P)))
    return floors.join(cuts, GROUP).selectExpr(GROUP, LANG, *(f"f{i}" for i in range(P)), *(f"m{i}" for i in range(P)), *(f"greatest(r{i}, sqrt(f{i})) as r{i}" for i in range(P)))


def _starts(fit: DataFrame, middles: DataFrame) -> DataFrame:
    """Three models for each group around its medians; their correlations: none, those of tanh scores, those of spatial signs."""
    r = _once(fit.join(small(middles.drop(LANG)), GROUP), **{f"z{i}": f"(x{i} - m{i}) / r{i}" for i in range(P)})
    norm = f"nullif(sqrt({' + '.join(f'z{i} * z{i}' for i in range(P))}), 0D)"
    r = _once(_once(r, norm=norm), **{f"t{i}": f"tanh(z{i})" for i in range(P)}, **{f"u{i}": f"coalesce(z{i} / norm, 0D)" for i in range(P)})
    sums = r.groupBy(GROUP).agg(*(F.expr(f"round(sum({k}{i} * {k}{j}), 9) as {k}{i}{j}") for k in "tu" for i, j in PAIRS))
    both = staged(middles.join(sums, GROUP))

    def model(start: int, kind: str | None) -> DataFrame:
        def cov(i: int, j: int) -> str:
            if i == j or kind is None:
                return f"r{i} * r{i}" if i == j else "0D"
            return f"coalesce({kind}{i}{j} / nullif(sqrt({kind}{i}{i} * {kind}{j}{j}), 0D), 0D) * r{i} * r{j}"

        return both.selectExpr(GROUP, LANG, f"{start} as start", *(f"f{i}" for i in range(P)), *(f"m{i}" for i in range(P)), *(f"{cov(i, j)} as c{i}{j}" for i, j in PAIRS))

    models = _factored(model(0, None).unionAll(model(1, "t")).unionAll(model(2, "u")))
    return models.drop("logdet").selectExpr("*", "cast('infinity' as double) as logdet", "true as fell")


def _factored(model: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """m0.. and c00, c10, c11..: the covariance, factored into l (unit lower triangle) and g (diagonal, no less than the floors); and the columns `kept`."""
    less = lambda i, j: "".join(f" - l{i}{k} * l{j}{k} * g{k}" if i != j else f" - l{j}{k} * l{j}{k} * g{k}" for k in range(j))
    for j in range(P):
        model = _once(model, **{f"g{j}": f"greatest(c{j}{j}{less(j, j)}, f{j})"})
        if j + 1 < P:
            model = _once(model, **{f"l{i}{j}": f"(c{i}{j}{less(i, j)}) / g{j}" for i in range(j + 1, P)})
    return model.selectExpr(GROUP, LANG, "start", *(kept or []), *NUMBERS, f"round({' + '.join(f'ln(g{i})' for i in range(P))}, 9) as logdet")


def _distance(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows, once for each model of their group, with d2, the squared Mahalanobis distance; null where the group has no model."""
    r = rows.join(model.drop(LANG, *TARGET), GROUP, "left")
    for i in range(P):
        r = _once(r, **{f"y{i}": f"x{i} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i))})
    return _once(r, d2=" + ".join(f"y{i} * y{i} / g{i}" for i in range(P))).drop(*(f"y{i}" for i in range(P)), *NUMBERS)


NUMBERS = [*(f"f{i}" for i in range(P)), *(f"m{i}" for i in range(P)), *(f"g{i}" for i in range(P)), *(f"l{i}{j}" for i, j in PAIRS if i != j)]
TARGET = [*(f"ta{i}" for i in range(P)), *(f"tb{i}{j}" for i, j in PAIRS)]
SUMS = ["n", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in PAIRS)]


def _nearest(fit: DataFrame, model: DataFrame) -> DataFrame:
    """For each group and start: number, sums and sums of products of the SHARE of the rows that is nearest."""
    at = _once(_distance(fit, model), slice=f"floor(ln(1 + d2) * {SLICES})")
    by = [GROUP, LANG, "start"]
    cells = at.groupBy(*by, "slice").agg(F.expr("cast(count(*) as double) as n"), *(F.expr(f"sum(x{i}) as s{i}") for i in range(P)), *(F.expr(f"sum(x{i} * x{j}) as q{i}{j}") for i, j in PAIRS))
    over = f"over (partition by {', '.join(by)}"
    cells = cells.selectExpr("*", f"{SHARE}D * sum(n) {over}) - coalesce(sum(n) {over} order by slice rows between unbounded preceding and 1 preceding), 0D) as room").filter("room > 0")
    # the slice that the share ends in counts in part
    return cells.groupBy(*by).agg(*(F.expr(f"sum({c} * least(1D, room / n)) as {c}") for c in SUMS))


def _targets(sums: DataFrame) -> DataFrame:
    """sums by group (staged). For each language mean ta.. and covariance tb.. that its groups are shrunk to: the language's, shrunk to that of all texts."""
    total = lambda *by: sums.groupBy(*by).agg(*(F.expr(f"sum({c}) as {c}") for c in SUMS))
    own = {f"a{i}": f"s{i} / n" for i in range(P)} | {f"b{i}{j}": f"q{i}{j} / n - s{i} / n * s{j} / n" for i, j in PAIRS}
    every = total().selectExpr(*(f"{c} as all{k}" for k, c in own.items()))
    return total(LANG).crossJoin(F.broadcast(every)).selectExpr(LANG, *(f"{_mixed(c, f'all{k}')} as t{k}" for k, c in own.items()))  # one row


def _mixed(own: str, target: str) -> str:
    """A mean or covariance of n texts, with PRIOR texts like the target."""
    return f"n / (n + {PRIOR}) * ({own}) + {PRIOR} / (n + {PRIOR}) * {target}"


def _concentrated(fit: DataFrame, model: DataFrame, known: DataFrame) -> DataFrame:
    """One concentration step of every group and start. What it makes no smaller stays as it was, with `fell` false."""
    # the scatter of the nearest SHARE of a normal sample falls short by this factor
    grow = SHARE / chi2_cdf(chi2_quantile(SHARE, P), P + 2)
    own = _nearest(fit, known).join(model.withColumnsRenamed({c: f"_{c}" for c in [*NUMBERS, "logdet"]}).drop("fell"), [GROUP, LANG, "start"])
    mean = [f"round({_mixed(f's{i} / n', f'ta{i}')}, 9) as m{i}" for i in range(P)]
    cov = [f"round(({_mixed(f'q{i}{j} / n - s{i} / n * s{j} / n', f'tb{i}{j}')}) * {grow}D, 9) as c{i}{j}" for i, j in PAIRS]
    kept = [*TARGET, *(f"_{c}" for c in [*NUMBERS, "logdet"])]
    own = own.selectExpr(GROUP, LANG, "start", *kept, *(f"_f{i} as f{i}" for i in range(P)), *mean, *cov)
    both = _once(_factored(own, kept), fell="logdet < _logdet - 1e-6D")
    return both.selectExpr(GROUP, LANG, "start", *TARGET, *(f"if(fell, {c}, _{c}) as {c}" for c in [*NUMBERS, "logdet"]), "fell")


def estimates(fit: DataFrame) -> DataFrame:
    """fit: _group, _lang, x0.., v0... One row for each group: its model of the least determinant."""
    starts = staged(_starts(fit, staged(_middles(fit))))
    target = _targets(staged(_nearest(fit, small(starts.filter("start = 0")))))
    model = staged(starts.join(target, LANG))
    for _ in range(STEPS):
        n, fell = model.agg(F.count("*"), F.max("fell")).first()
        if not fell:
            break
        new = staged(_concentrated(fit, model, F.broadcast(model) if n <= 50_000 else model))
        discard(model)
        model = new
    first = F.row_number().over(Window.partitionBy(GROUP).orderBy("logdet", "start"))
    return model.withColumn("_first", first).filter("_first = 1").select(GROUP, LANG, *NUMBERS)


def verdicts(stats: DataFrame) -> DataFrame:
    """stats (of `base_statistics`, with lang and source), staged by the caller: the same rows with kept and d2."""
    rows = _grouped(_features(stats))
    fit = staged(rows.filter("not base_failed").select(GROUP, LANG, *(f"x{i}" for i in range(P)), *(f"v{i}" for i in range(P))))
    judged = _distance(rows, small(staged(estimates(fit))))
    discard(fit)
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_quantile(CUTOFF, P), F.lit(True))
    return judged.withColumn("kept", kept).drop(GROUP, LANG, *(f"x{i}" for i in range(P)), *(f"v{i}" for i in range(P)))


def judge(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, lang, source. One row per row: doc_id, n_words, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2.

    A null or empty text has no words and fails the base rules; null languages and sources are groups like others; repeated
    rows are judged alike, each by itself; a null doc_id stays; columns other than these are neither read nor returned; an empty table gives an
    empty result.
    """
    stats = base_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text")
    return verdicts(staged(stats)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, all columns."""
    held = staged(base_statistics(docs.select(F.struct(*docs.columns).alias("_row"), "text", "lang", "source")).drop("text"))
    return verdicts(held).filter("kept").select("_row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
