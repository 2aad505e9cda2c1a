"""Ligatures and full-width letters are words in the cleaning queries, held against plain Python."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import text as T
from ledgerlens.operators import tone
from ledgerlens.plans import section_queries, tone_queries

TEXT = "ﬂooding ｗａｔｅｒ eﬀort foo¨bar"


@pytest.fixture
def given(spark, tmp_path):
    spark.createDataFrame([(1, TEXT, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    page = " ".join([TEXT] * 4)
    spark.createDataFrame([(1, 0, "user", page)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_cleaning_queries(spark, given):
    assert section_queries.QUERIES["clean_text"][0](spark, given).first()["cleaned"] == "flooding water effort foo bar"
    row = section_queries.QUERIES["conversion_log"][0](spark, given).first()
    assert "flooding water effort" in row["cleaned"]


def test_tone(spark, given):
    plain = [w for t in TEXT.split() if (w := unicodedata.normalize("NFKC", t).lower()).isalpha() and len(w) >= 3]
    assert plain == ["flooding", "water", "effort"]
    df = spark.createDataFrame([("a", TEXT)], "filename string, text string")
    assert df.select(T.tone_tokens(F.col("text"), ())).first()[0] == plain
    assert tone.tone_metrics(df, {"Positive": ["flooding"]}, ["water"]).select("total_words", "LM_Positive", "esg_count").first()[:] == (3, 1, 1)
    top = tone_queries.QUERIES["tone_metrics"][0](spark, given).first()["top_20_words"]
    assert "flooding" in top and "water" in top


def test_normal_forms_are_pythons_and_need_none(spark):
    """Random marks, letters and syllables come out as Python has them, by plans without a Python step; null is empty."""
    pool = [c for c in map(chr, (*range(1, 0xD800), *range(0xE000, 0x1C000), *range(0x1D400, 0x30000))) if unicodedata.combining(c) or unicodedata.normalize("NFKC", c) != c]
    rnd = random.Random(3)
    texts = ["", None, *("".join(rnd.choices([*"ab \n", *rnd.choices(pool, k=9)], k=12)) for _ in range(5000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.nfkc(F.col("t")))
    assert df.orderBy("i").collect() == [(i, unicodedata.normalize("NFKC", t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([("a", TEXT)], "filename string, text string")
    for made in (df, docs.select(T.clean_tokens("text")), tone.tone_metrics(docs, {})):
        assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
