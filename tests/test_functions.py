import unicodedata

import pytest
from oracle import rows_of
from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M
from ledgerlens.functions import names as N
from ledgerlens.functions import text as T
from ledgerlens.functions import vocabulary as V
from ledgerlens.functions.columns import ratio, rounded
from ledgerlens.functions.company_html import company_fields


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (N.drop_stem_prefix, "360ONE_360ONE_Annual Report_2021-22.pdf", "360ONE_Annual Report_2021-22.pdf"),
        (N.drop_prefix, "AARTIND_AARTIND_Annual Report_2023-24.txt", "AARTIND_Annual Report_2023-24.txt"),
        (N.drop_prefix, "plain.txt", "plain.txt"),
        (N.first_part, "AARTIND_Annual_Report_2023-24.txt", "AARTIND"),
        (N.first_year, "AARTIND_Annual_Report_2023-24.txt", "2023"),
        (N.first_part, "ABC.txt", "ABC"),
        (N.first_year, "ABC.txt", "Unknown"),
        (N.company, "ABC_Annual Report_2021-22.pdf", "ABC"),
        (N.year, "ABC_Annual Report_2021-22.pdf", "2021-22"),
        (N.year, "ABC_BRSR.pdf", "Unknown"),
        (N.year, None, "Unknown"),
        (N.safe, "a<b>:c?", "a_b__c_"),
        (N.stem, ".hidden", ".hidden"),
        (N.ticker, " tcs ", "TCS"),
        (T.stripped, "\x1c a b\xa0", "a b"),
        (lambda c: T.first_of(c, V.INCORPORATION_PATTERNS), "Incorporated in 1990. Year of Incorporation: 1996", "1996"),
        (lambda c: T.first_of(c, V.INCORPORATION_PATTERNS), "Date of Incorporation 12/03/1987", "1987"),
        (lambda c: T.first_of(c, V.INCORPORATION_PATTERNS), "Established 1950", None),
        (lambda c: T.clean_tokens(c), "Sustain-\nability report 2023-24", ["sustainability"]),
        (lambda c: T.clean_tokens(c), "Page 3 of 10\nWater saved", ["water", "saved"]),
        (lambda c: T.clean_tokens(c), None, []),
        (lambda c: T.tone_tokens(c, ()), "co2 ab éco don't", ["éco"]),
        (lambda c: T.tone_tokens(c, (), True), "ﬁne", ["fine"]),
        (lambda c: T.tokens(c), "", []),
        (lambda c: T.ngrams(T.tokens(c), 2), "a", []),
        (lambda c: T.ngrams(T.tokens(c), 2), "a b c", ["a b", "b c"]),
        (lambda c: T.loose_tokens(c), "(Water!) 12 --x-- “", ["water", "x"]),
        (lambda c: T.without_stopwords(c, ["the"])[0], "The big, the small.", "big, small."),
        (lambda c: T.index_tokens(c, ["the"], {"waters": "water"}), "http://x.y The waters, 12 oil", ["water", "oil"]),
    ],
)
def test_text_and_names(spark, f, given, want):
    assert one(spark, f, given) == want


def test_tokens_split_as_unicode_does(spark):
    odd = "".join(f"x{chr(c)}" for c in range(0x3100) if chr(c).isspace() or unicodedata.category(chr(c)) in ("Cc", "Zs", "Cf"))
    assert one(spark, T.tokens, odd) == odd.split()


def test_headings(spark):
    got = one(spark, lambda c: T.numbered_titles(c, "Principle", r"\d+"), "Principle 1: Ethics \nprinciple 2 - Safety\nPrinciple x: no")
    assert [(r["number"], r["title"]) for r in got] == [("1", "Ethics"), ("2", "Safety")]
    assert one(spark, lambda c: T.lines_with(c, ["indicator"]), " An Indicator \nnothing") == ["An Indicator"]


def test_rounding(spark):
    df = spark.createDataFrame([(1, 128), (0, 0), (3, 640)], "a int, b int")
    own = ratio(F.col("a"), F.col("b"))
    assert rows_of(df.select(rounded(own, 6), rounded(own, 6, "python"))) == [(0.007813, 0.007812), (0.0, 0.0), (0.004688, 0.004687)]
    with pytest.raises(ValueError, match="rounding"):
        rounded(own, 6, "up")


def test_tone_ratios(spark):
    n = {c: F.lit(0) for c in V.TONE_CATEGORIES} | {"Positive": F.lit(3), "Negative": F.lit(1)}
    r = M.tone_ratios(n, F.lit(10), F.lit(5), F.lit(40), F.lit(2))
    got = spark.range(1).select(*(v.alias(k) for k, v in r.items())).first()
    assert (got["net_tone"], got["sentiment_score"], got["polarity_ratio"], got["esg_density"]) == (0.2, 0.4, 0.75, 200.0)
    zero = M.tone_ratios({c: F.lit(0) for c in V.TONE_CATEGORIES}, F.lit(0), F.lit(0), F.lit(0), F.lit(0))
    assert set(spark.range(1).select(*(v.alias(k) for k, v in zero.items())).first()) == {0, 0.0}


def test_stars_and_scores(spark):
    df = spark.createDataFrame([(0.001,), (0.02,), (0.07,), (0.5,)], "p double")
    assert [r[0] for r in df.select(M.stars(F.col("p"))).collect()] == ["***", "**", "*", ""]
    assert rows_of(spark.range(1).select(M.min_max(F.lit(2.0), F.lit(2.0), F.lit(2.0)), M.z_score(F.lit(2.0), F.lit(2.0), F.lit(0.0)))) == [(0.0, 0.0)]


def test_company_pages():
    row = "<table><tr><td>Sector</td><td>{}</td></tr></table>"
    assert company_fields(row.format("IT")) == ("Not Found", "IT", "Not Found", "Found")
    assert company_fields("<table><tr><td>Sector</td><td> IT </td></tr></table>")[1] == "IT"
    assert company_fields("") == ("Not Found", "Not Found", "Not Found", "No industry data found")
    assert company_fields('<h1 class="big company"> A &amp; B </h1><p>Industry: Banks\n')[::2] == ("A & B", "Banks")


def test_vocabulary_sizes():
    assert [len(set(x)) for x in (V.ESG_KEYWORDS, V.REPORT_STOPWORDS, V.ENGLISH_STOPWORDS, V.DOMAIN_STOPWORDS, V.INDEX_STOPWORDS)] == [120, 64, 112, 70, 49]
    assert len({*V.ENVIRONMENTAL_TERMS, *V.SOCIAL_TERMS, *V.GOVERNANCE_TERMS}) == 183
