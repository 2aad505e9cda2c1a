"""The severity index: how far a document's tone outruns its substance.

Substance is a sum of TF-IDF weights, tone is a polarity; both are standardised over the corpus, and the index is their difference. Two
aggregates stand between: document frequencies, and the moments of the two scores, which are one row.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.columns import bound, one_of, ratio, rounded
from ..functions.metrics import min_max, z_score
from ..functions.text import bigrams, index_tokens, tokens
from ..sources.staging import staged

ESG_TERMS = sorted({*V.ENVIRONMENTAL_TERMS, *V.SOCIAL_TERMS, *V.GOVERNANCE_TERMS})
#: The columns of the index.
COLUMNS = ["company", "file", "esgsi", "normalized_sustainability_score", "normalized_sentiment_score", "sentiment_polarity", "sentiment_subjectivity", "sustainability_score_raw", "label"]


def term_counts(docs: DataFrame, words: Column, key: str = "doc_id") -> DataFrame:
    """key, term, tf: uni- and bigrams of each document, one row for each that it holds."""
    # sorted as plain strings, without places: runs of equal ones are counted
    own = bound(docs.select(key, words.alias("_own")), _sorted=F.sort_array(F.concat(F.col("_own"), bigrams(F.col("_own"))))).drop("_own")
    term = lambda i: F.get(F.col("_sorted"), i)
    own = bound(own, _starts=F.filter(F.transform("_sorted", lambda t, i: F.when((i == 0) | (t != term(i - 1)), i)), lambda i: i.isNotNull()))
    end = lambda k: F.coalesce(F.get(F.col("_starts"), k + 1), F.size("_sorted"))
    return own.select(key, F.inline(F.transform("_starts", lambda i, k: F.struct(term(i).alias("term"), (end(k) - i).cast("long").alias("tf")))))


def vocabulary(counts: DataFrame, n_docs: int, max_share: float = 0.95, most: int = 10_000) -> DataFrame:
    """term, df, idf: terms in at least two documents (one, of fewer than four documents) and at most `max_share` of them; the `most` most frequent, equal ones by name."""
    least = 2 if n_docs >= 4 else 1
    by = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n")).filter((F.col("df") >= least) & (F.col("df") <= max_share * n_docs))
    kept = by.orderBy(F.desc("n"), "term").limit(most)
    return kept.select("term", "df", (F.log(F.lit(1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def tfidf(counts: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term, weight: tf * idf, each document's weights of length one. `terms` has at most as many rows as the vocabulary's parameter says, and is broadcast."""
    raw = counts.join(F.broadcast(terms.select("term", "idf")), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("weight"))


def on_topic(term: Column, topics: Iterable[str]) -> Column:
    """Does the term hold any topic as a substring?"""
    topics = list(topics)
    return F.exists(F.array(*map(F.lit, topics)), lambda t: F.contains(term, t)) if topics else F.lit(False)


def sustainability_scores(docs: DataFrame, words: Column, topics: Iterable[str] = ESG_TERMS, key: str = "doc_id", max_share: float = 0.95, most: int = 10_000) -> DataFrame:
    """key, score for every row of docs: the sum of a document's weights of terms on topic; where the corpus has no such term, of all terms.

    Documents without a term of the vocabulary score 0.0. keys are taken to be different and not null.
    """
    n_docs = docs.count()
    counts = staged(term_counts(docs, words, key))  # read for the vocabulary and for the scores
    terms = staged(vocabulary(counts, n_docs, max_share, most).withColumn("hit", on_topic(F.col("term"), topics)))
    terms = terms.crossJoin(F.broadcast(terms.agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("any"))))  # one row
    raw = counts.join(F.broadcast(terms), "term").select(key, (F.col("tf") * F.col("idf")).alias("raw"), (F.col("hit") | ~F.col("any")).alias("in"))
    # the norm divides the sum, so that both come out of one aggregate
    by = raw.groupBy(key).agg((F.sum(F.when(F.col("in"), F.col("raw")).otherwise(0.0)) / F.sqrt(F.sum(F.col("raw") * F.col("raw")))).alias("score"))
    return docs.select(key).join(by, key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))


def sentiment(text: Column, lexicon: Iterable[tuple[str, float, float]], rounding: str = "spark") -> tuple[Column, Column]:
    """Polarity and subjectivity: means over the tokens that the lexicon (word, polarity, subjectivity) has; 0.0 without any."""
    rows = sorted(lexicon)
    both = F.create_map(*(x for w, p, s in rows for x in (F.lit(w), F.struct(F.lit(float(p)).alias("p"), F.lit(float(s)).alias("s")))))
    # most tokens are in no lexicon, and are left out before one is looked up
    found = F.transform(F.filter(tokens(F.lower(text)), one_of(w for w, *_ in rows)), lambda t: F.element_at(both, t))
    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))
    sums = F.aggregate(found, zero, lambda a, x: F.struct((a["p"] + x["p"]).alias("p"), (a["s"] + x["s"]).alias("s"), (a["n"] + 1).alias("n")))
    return rounded(ratio(sums["p"], sums["n"]), 6, rounding), rounded(ratio(sums["s"], sums["n"]), 6, rounding)


def moments(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One row: least, largest, mean and population deviation of each column."""
    return df.agg(*(f(c).alias(f"{c}_{k}") for c in columns for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))))


def normalised(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """df with {c}_minmax and {c}_z of each column."""
    columns = list(columns)
    own = df.crossJoin(F.broadcast(moments(df, columns)))  # one row
    made = {f"{c}_minmax": min_max(F.col(c), F.col(f"{c}_min"), F.col(f"{c}_max")) for c in columns} | {f"{c}_z": z_score(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_std")) for c in columns}
    return own.withColumns(made).drop(*(f"{c}_{k}" for c in columns for k in ("min", "max", "mean", "std")))


def label(index: Column) -> Column:
    return F.when(index > 0, "Potential ESGwashing").otherwise("Likely Genuine")


def severity_index(docs: DataFrame, polarity: Iterable[tuple[str, float, float]], company: Column, file: Column, stops: Iterable[str] = (), topics: Iterable[str] = ESG_TERMS, lemmas: Mapping[str, str] | None = None, key: str = "doc_id", rounding: str = "spark") -> DataFrame:
    """docs: key, text. One row for each: COLUMNS. Tone is that of the raw text; the label goes by the index before it is rounded."""
    p, s = sentiment(F.coalesce(F.col("text"), F.lit("")), polarity, rounding)
    tone = bound(docs.select(key, company.alias("company"), file.alias("file"), "text"), sentiment_polarity=p, sentiment_subjectivity=s).drop("text")
    score = sustainability_scores(docs, index_tokens("text", {*V.ENGLISH_STOPWORDS, *V.INDEX_STOPWORDS, *stops}, lemmas), topics, key)
    both = staged(tone.join(score, key))  # numbers and names alone; read for the moments and for the index
    own = normalised(both, ["sentiment_polarity", "score"]).withColumn("_index", F.col("sentiment_polarity_z") - F.col("score_z"))
    r = lambda c: rounded(F.col(c), 6, rounding)
    return own.select(
        "company", "file", r("_index").alias("esgsi"), r("score_minmax").alias("normalized_sustainability_score"), r("sentiment_polarity_minmax").alias("normalized_sentiment_score"),
        "sentiment_polarity", "sentiment_subjectivity", r("score").alias("sustainability_score_raw"), label(F.col("_index")).alias("label"),
    )
