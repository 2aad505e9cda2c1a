"""Tone metrics of documents by word lists: two schemas, and summaries by company.

All counts are made within a document's own row: its tokens are sorted once with their positions, and the runs of equal ones are its
words with their counts. Nothing is shuffled; word lists become hash sets in the plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.columns import bound, col, one_of, ratio, rounded
from ..functions.metrics import tone_ratios
from ..functions.text import loose_tokens, tone_tokens
from .quantiles import quantiles

#: The names and the order of the reference tables' columns.
TONE_COLUMNS = [
    "filename", "total_words", "unique_words", "type_token_ratio", "avg_word_length", "net_tone", "sentiment_score", "polarity_ratio", "esg_count",
    "esg_density", "uncertainty_ratio", "litigiousness_ratio", "constraining_ratio", "modal_strength_ratio", "complexity_ratio", "content_richness",
    "top_20_words", *(f"LM_{c}" for c in V.TONE_CATEGORIES),
]
#: Categories of the short schema and their columns.
SHORT_COLUMNS = {"Positive": "Positive_Words", "Negative": "Negative_Words", "Complexity": "Complexity_Words", "Constraining": "Constraining_Words", "Litigious": "Litigious_Words", "Strong": "Strong_Modal_Words", "Weak": "Weak_Modal_Words", "Uncertainty": "Uncertainty_Words"}
#: What summaries by company average.
AVERAGED = ["Net_Tone", "Tone_Ratio", "Positive_Words", "Negative_Words", "Complexity_Words", "Constraining_Words", "Litigious_Words", "Strong_Modal_Words", "Weak_Modal_Words", "Uncertainty_Words", "Total_Words_Clean"]


def with_words(df: DataFrame, tokens: Column, into: str = "words") -> DataFrame:
    """df with array<struct<n, at, word>>: a document's distinct tokens, how often each occurs and where first (from 0), in no stated order."""
    own = bound(df, _sorted=F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("word"), i.alias("at")))))
    word = lambda i: F.get(F.col("_sorted"), i)
    starts = F.filter(F.transform("_sorted", lambda s, i: F.when((i == 0) | (s["word"] != word(i - 1)["word"]), i)), lambda i: i.isNotNull())
    own = bound(own, _starts=starts)
    end = lambda k: F.coalesce(F.get(F.col("_starts"), k + 1), F.size("_sorted"))
    words = F.transform("_starts", lambda i, k: F.struct((end(k) - i).cast("long").alias("n"), word(i)["at"].alias("at"), word(i)["word"].alias("word")))
    return bound(own, **{into: words}).drop("_sorted", "_starts")


def _count(words: str, hit=None) -> Column:
    """How many tokens hold the predicate on words."""
    own = F.col(words) if hit is None else F.filter(words, lambda w: hit(w["word"]))
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, w: a + w["n"])


def top_words(words: str, most: int = 20) -> Column:
    """'word:count | ...', the most frequent first, equal ones by their first place."""
    order = F.slice(F.sort_array(F.transform(words, lambda w: F.struct((-w["n"]).alias("n"), w["at"].alias("at"), w["word"].alias("word")))), 1, most)
    return F.array_join(F.transform(order, lambda w: F.concat(w["word"], F.lit(":"), (-w["n"]).cast("string"))), " | ")


def tone_metrics(docs: DataFrame, lexicon: Mapping[str, Iterable[str]], esg: Iterable[str] = V.ESG_KEYWORDS, stops: Iterable[str] = V.REPORT_STOPWORDS, name: str | Column = "filename", text: str = "text", normalise: bool = True, rounding: str = "spark") -> DataFrame:
    """The columns of TONE_COLUMNS for each row of docs.

    lexicon: words by category (missing ones are empty), and stopwords as 'Stop'. A null or empty text has no words: counts and ratios are zero, and the
    top words are empty. An empty table gives an empty result.
    """
    own = docs.select(col(name).alias("filename"), F.col(text).alias("_text"))
    own = bound(own, _tokens=tone_tokens("_text", {*stops, *lexicon.get("Stop", ())}, normalise)).drop("_text")
    known = one_of({*esg, *(w for c in V.TONE_CATEGORIES for w in lexicon.get(c, ()))})
    own = with_words(own, F.col("_tokens"))
    # most words are in no list: they are looked at once, and the categories' counts only at the others
    own = bound(own, _hits=F.filter("words", lambda w: known(w["word"])))
    counts = {f"LM_{c}": _count("_hits", one_of(lexicon.get(c, ()))) for c in V.TONE_CATEGORIES}
    totals = {"total_words": F.size("_tokens").cast("long"), "unique_words": F.size("words").cast("long"), "_letters": F.length(F.array_join("_tokens", "")).cast("long")}
    own = bound(own, **totals, esg_count=_count("_hits", one_of(esg)), top_20_words=top_words("words"), **counts)
    n = {c: F.col(f"LM_{c}") for c in V.TONE_CATEGORIES}
    ratios = tone_ratios(n, F.col("total_words"), F.col("unique_words"), F.col("_letters"), F.col("esg_count"), rounding)
    return own.withColumns(ratios).select(TONE_COLUMNS)


def category_counts(docs: DataFrame, lexicon: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, category, n: how many of a document's tokens are in each category of `lexicon` (category, word), none left out. A word may be in many categories.

    A join: for lexicons that are too large for a plan. Only the lexicon's words are counted, and counts are added up before they are shuffled.
    """
    words = with_words(docs.select(key, tokens.alias("_tokens")), F.col("_tokens")).select(key, F.inline_outer("words"))
    found = words.select(key, "word", "n").join(lexicon.select("category", "word").distinct(), "word")
    return found.groupBy(key, "category").agg(F.sum("n").alias("n"))


def short_tone(docs: DataFrame, lexicon: Mapping[str, Iterable[str]], company: Column, year: Column, file: Column, text: str = "text", rounding: str = "spark") -> DataFrame:
    """The short schema: counts alone, with company and year. Net_Tone is a count here. Null and empty texts count nothing."""
    stop = one_of(lexicon.get("Stop", ()))
    known = one_of({w for c in SHORT_COLUMNS for w in lexicon.get(c, ())})
    own = bound(docs.select(company.alias("Company"), year.alias("Year"), file.alias("File_Name"), F.col(text).alias("_text")), _raw=loose_tokens("_text")).drop("_text")
    own = bound(own, _clean=F.filter("_raw", lambda t: ~stop(t)))
    own = bound(own, _hits=F.filter("_clean", known))
    n = {v: F.size(F.filter("_hits", one_of(lexicon.get(c, ())))).cast("long") for c, v in SHORT_COLUMNS.items()}
    own = bound(own, Total_Words_Raw=F.size("_raw").cast("long"), Total_Words_Clean=F.size("_clean").cast("long"), **n)
    pos, neg = F.col("Positive_Words"), F.col("Negative_Words")
    own = own.withColumn("Net_Tone", pos - neg).withColumn("Tone_Ratio", rounded(ratio(pos, pos + neg), 4, rounding))
    first = ["Company", "Year", "File_Name", "Total_Words_Raw", "Total_Words_Clean", "Positive_Words", "Negative_Words", "Net_Tone", "Tone_Ratio"]
    return own.select(*first, *(c for c in SHORT_COLUMNS.values() if c not in first))


def company_summary(tone: DataFrame, digits: int = 2) -> DataFrame:
    """Averages of the short schema by company, and its number of files. Rows without a company are left out."""
    known = tone.filter(F.col("Company").isNotNull())
    return known.groupBy("Company").agg(*(F.round(F.avg(c), digits).alias(f"Avg_{c}") for c in AVERAGED), F.count("*").alias("Number_of_Files"))


def top_companies(summary: DataFrame, by: str = "Avg_Net_Tone", most: int = 5) -> DataFrame:
    """The companies with the largest values, equal ones by name: a top-k, never a full sort."""
    return summary.select("Company", by, "Number_of_Files").orderBy(F.desc_nulls_last(by), "Company").limit(most)


def describe(df: DataFrame, columns: Iterable[str], digits: int = 4) -> DataFrame:
    """One row for each column: count, mean, sample deviation, least, exact quartiles, largest. Quartiles are interpolated."""
    names = list(columns)
    cuts = quantiles(df, names, (0.25, 0.5, 0.75))
    of = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = lambda c: {k: f(c) for k, f in of.items()} | {f"p{p}": F.lit(cuts[c][k]).cast("double") for k, p in enumerate((25, 50, 75))}
    order = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    aggregates = [F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), *(F.round(row(c)[k], digits).alias(k) for k in order)) for c in names]
    return df.select(*(F.col(c).cast("double").alias(c) for c in names)).agg(F.array(*aggregates).alias("_all")).select(F.inline("_all"))
