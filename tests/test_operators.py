import random
import re
from collections import Counter

from oracle import rows_of
from pyspark.sql import functions as F

from ledgerlens.functions.text import index_tokens, tokens
from ledgerlens.operators import attributes, naming, pages, sections, severity, tone
from ledgerlens.plans.inputs import LEXICON


def test_top_words_keep_first_places(spark):
    df = tone.with_words(spark.createDataFrame([("b a b c a",), ("",), (None,)], "t string"), tokens("t"))
    assert [r[0] for r in df.select(tone.top_words("words")).collect()] == ["b:2 | a:2 | c:1", "", ""]


def test_tone_against_plain_python(spark):
    r = random.Random(1)
    texts = [" ".join(r.choices(["the", "That", "and", "orre", "x1", "des", "policy", "éco,", "ing"], k=r.randint(0, 60))) for _ in range(40)] + [None]
    got = tone.tone_metrics(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "filename string, text string"), LEXICON).collect()
    stops = {*tone.V.REPORT_STOPWORDS, *LEXICON["Stop"]}
    for row, t in zip(sorted(got, key=lambda x: int(x["filename"])), texts, strict=True):
        own = [w for w in (t or "").lower().split() if w.isalpha() and len(w) >= 3 and w not in stops]
        assert (row["total_words"], row["unique_words"], row["LM_Positive"]) == (len(own), len(set(own)), sum(w in LEXICON["Positive"] for w in own))
        assert row["top_20_words"] == " | ".join(f"{w}:{c}" for w, c in Counter(own).most_common(20))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, filename string, page_num int, text string, width double, height double")
    assert tone.tone_metrics(none, LEXICON).count() == 0
    assert pages.conversion_log(pages.triage(none)).count() == 0
    assert sections.extract(none)[0].count() == 0
    assert severity.sustainability_scores(none, index_tokens("text", [])).count() == 0


def blocks(spark, hits):
    df = spark.createDataFrame([(1, p) for p in hits], "doc_id long, page_num int")
    return sorted(p for _, p in rows_of(sections.largest_block(df)))


def test_largest_block(spark):
    assert blocks(spark, [2, 3, 7, 8, 9, 12]) == [7, 8, 9]
    assert blocks(spark, [1, 2, 5, 6]) == [1, 2]
    assert blocks(spark, [1, 4, 9]) == [1, 4, 9]


def test_neighbours(spark):
    hits = spark.createDataFrame([(1, 0), (1, 4)], "doc_id long, page_num int")
    sizes = spark.createDataFrame([(1, 6)], "doc_id long, n_pages int")
    assert sorted(p for _, p in rows_of(sections.with_neighbours(hits, sizes))) == [0, 1, 3, 4, 5]


def types(spark, rows):
    df = spark.createDataFrame([(1, i, True, *r) for i, r in enumerate(rows)], "doc_id long, page_num int, hit boolean, strong string, weak string")
    return sections.report_types(df).first()["report_type"]


def test_report_types(spark):
    assert types(spark, [(None, "BRR"), ("BRSR", None), (None, "BRR")]) == "BRSR"
    assert types(spark, [(None, "BRR"), (None, "BRSR")]) == "BRR"
    assert types(spark, [(None, None)]) == "BRSR"


def test_first_frames(spark):
    text = "\n".join("hit" if i == 3 else f"line {i}" for i in range(40))
    row = sections.first_frames(spark.createDataFrame([(1, 0, text)], "doc_id long, page_num int, text string"), {"h": "HIT"}).first()
    assert row["line"] == 3
    assert row["context"].split("\n") == text.split("\n")[:23]


def test_pattern_bank_order():
    bank = sections.pattern_bank({"principles": [("1", "Ethics (all)"), ("1", "Later")], "sections": [], "keywords": ["x.y"] * 12})
    assert list(bank) == ["Principle_1", "BRSR_Main", "BRR_Main", "Keyword_x.y"]
    assert bank["Principle_1"].endswith("Later")


def test_template(spark):
    t = spark.createDataFrame([(0, "Principle 1: Ethics\nKey Indicator\n"), (1, "Section A - General\n| Table |\nSection A of the form, General Disclosures")], "page_num int, text string")
    s = sections.template_structure(t).first()
    assert [tuple(x) for x in s["principles"]] == [("1", "Ethics")]
    assert s["keywords"] == ["Key Indicator", "Section A of the form, General Disclosures"]
    assert s["table_headers"] == ["| Table |"]
    p = sections.template_profile(t).first()
    assert (p["template_pages"], p["has_principles"], p["has_sections"]) == (2, True, True)
    assert p["sample_patterns"] == ["Section A of the form, General Disclosures"]


def test_dense_pages(spark):
    df = spark.createDataFrame([("1" * 28 + "a" * 72,), ("1" * 29 + "a" * 71,), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(pages.is_dense(F.col("text"))).collect()] == [False, True, False, False]


def test_triage(spark):
    rows = [(1, 0, "Balance Sheet " * 9, None, None), (1, 1, "1 " * 99, [[[" a ", None, ""], ["b"]]], None), (1, 2, "tiny", None, "o" * 51), (1, 3, "tiny", None, "o" * 50), (1, 4, "w" * 90, None, None)]
    df = pages.triage(spark.createDataFrame(rows, "doc_id long, page_num int, text string, tables array<array<array<string>>>, ocr string"))
    assert [r["action"] for r in df.orderBy("page_num").collect()] == ["financial", "table", "ocr", "short", "text"]
    d = pages.document_text(df).first()
    assert d["text"] == "a b\n\n" + "o" * 51 + "\n\n" + "w" * 90
    assert d["skipped_pages"] == [1, 2, 4]


def test_landscape_blocks(spark):
    df = spark.createDataFrame([([(2.0, 1.0, "c"), (1.0, 5.0, "b"), (1.0, 2.0, " ")],)], "b array<struct<y: double, x: double, text: string>>")
    assert df.select(pages.block_text(F.col("b"))).first()[0] == "b\nc"


def test_numbered_names(spark):
    rows = [("x/a.txt", "a.txt"), ("y/a.txt", "a.txt"), ("z/a.txt", "a.txt"), ("q/a_1.txt", "a_1.txt"), ("q/noext", "noext")]
    got = dict(rows_of(naming.copy_plan(spark.createDataFrame(rows, "path string, file_name string"))))
    assert got == {"x/a.txt": "a.txt", "y/a.txt": "a_2.txt", "z/a.txt": "a_3.txt", "q/a_1.txt": "a_1.txt", "q/noext": "noext"}


def test_tfidf_of_a_small_corpus(spark):
    docs = spark.createDataFrame([(1, "water energy water"), (2, "energy policy"), (3, "policy water"), (4, "green plan")], "doc_id long, text string")
    got = dict(rows_of(severity.sustainability_scores(docs, index_tokens("text", []), ["water", "energy", "policy"]).select("doc_id", F.round("score", 6))))
    assert got == {1: 1.341641, 2: 1.414214, 3: 1.414214, 4: 0.0}
    assert dict(rows_of(severity.sustainability_scores(docs, index_tokens("text", []), ["nothing"]).select("doc_id", F.round("score", 6)))) == got


def test_labels(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 0.0)], "k long, p double, s double")
    own = severity.normalised(df, ["p", "s"]).select("k", severity.label(F.col("p_z") - F.col("s_z")))
    assert sorted(rows_of(own)) == [(1, "Likely Genuine"), (2, "Potential ESGwashing")]


def test_industry_codes_and_fallback(spark):
    df = spark.createDataFrame([("tcs", 404, None), ("zzz", 500, "x"), ("a", None, None), ("b", 200, "<p>Sector: Oil")], "ticker string, status_code int, html string")
    found = attributes.industry(df)
    assert sorted((r["ticker"], r["status"]) for r in found.collect()) == [("A", "Request Error"), ("B", "Found"), ("TCS", "Company not found"), ("ZZZ", "HTTP Error: 500")]
    both = {r["ticker"]: (r["sector"], r["status"]) for r in attributes.with_fallback(found).collect()}
    assert both == {"B": ("Oil", "Found"), "TCS": ("IT", "Found (Fallback)"), "ZZZ": (None, "Not in fallback database"), "A": (None, "Not in fallback database")}


def test_exact_quantiles(spark):
    import numpy as np

    from ledgerlens.operators.quantiles import quantiles

    r = np.random.default_rng(1)
    values = [None, *(float(x) for x in r.normal(size=5000)), *([0.5] * 3000), *(float(x) for x in r.normal(size=2000) * 1e6)]
    df = spark.createDataFrame([(v, i % 7, None) for i, v in enumerate(values)], "x double, k int, none double").repartition(5)
    shares = (0, 0.01, 0.25, 0.5, 0.777, 0.99, 1)
    got = quantiles(df, ["x", "k", "none"], shares)
    assert np.allclose(got["x"], np.quantile(values[1:], shares), rtol=1e-12)
    assert got["k"] == list(np.quantile([i % 7 for i in range(len(values))], shares))
    assert got["none"] == [None] * len(shares)
    assert quantiles(df.limit(0), ["x"], (0.5,)) == {"x": [None]}


def test_taken_numbers_are_passed_over(spark):
    from ledgerlens.operators import naming

    names = ["a.txt"] * 6 + ["a_1.txt", "a_3.txt", "a_4.txt", "a_10.txt", "b.txt", "b_1.txt", "c", "c"]
    df = spark.createDataFrame([(f"{i:03}", n) for i, n in enumerate(names)] + [("zz", None)], "path string, file_name string")
    got = {r["path"]: r["dest_name"] for r in naming.numbered(df).collect()}
    assert [got[f"{i:03}"] for i in range(6)] == ["a.txt", "a_2.txt", "a_5.txt", "a_6.txt", "a_7.txt", "a_8.txt"]
    assert [got[f"{i:03}"] for i in range(6, 14)] == ["a_1.txt", "a_3.txt", "a_4.txt", "a_10.txt", "b.txt", "b_1.txt", "c", "c_1"]
    assert naming.numbered(df).columns == ["path", "file_name", "dest_name"]


def test_term_counts_are_those_of_plain_python(spark):
    """Terms of none, one, repeated and nested words; terms are sorted as plain strings, without places."""
    texts = ["", "one", "aaa aaa aaa", "bbb aaa bbb aaa", "aaa\tbbb\x0bccc-ddd É9eee\x1cfff http://x.y ggg", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = severity.term_counts(docs, index_tokens("text", ["ggg"]))
    want = []
    for i, t in enumerate(texts):
        own = [w for w in re.split("[^a-z]+", re.sub(r"http\S+|www\S+", " ", t or "").lower()) if len(w) >= 3 and w != "ggg"]
        want += [(i, w, n) for w, n in Counter([*own, *(" ".join(p) for p in zip(own, own[1:]))]).items()]
    assert sorted(rows_of(counts)) == sorted(want)
    assert " at, " not in counts._jdf.queryExecution().analyzed().toString() and " AS at" not in counts._jdf.queryExecution().analyzed().toString()
