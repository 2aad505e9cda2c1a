import random

from oracle import same
from plain import SF

from ledgerlens.llm import licenses


def test_rows_are_those_of_the_sql(spark, con):
    same(licenses.op3_license_scan(spark, SF), con, licenses.OP3_SQL)


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["license"]) for r in licenses.scan(df).collect()}


def test_templates_are_found_where_they_are(spark):
    r = random.Random(1)
    noise = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    texts = [f"{noise(r.randint(0, 40))}\n# {body.upper()} {noise(r.randint(0, 40))}" for body in licenses.TEMPLATES.values()]
    got = found(spark, texts)
    assert {(i, k) for i, k in enumerate(licenses.TEMPLATES)} <= got
    assert {k for _, k in got if _ >= len(texts)} == set()


def test_texts_without_marks_have_no_candidates(spark, documents):
    """What the filter before windows leaves out gives no rows; neither do several passes change any."""
    df = spark.createDataFrame([(d, t) for d, t, *_ in documents], "doc_id long, text string")
    rows = lambda **how: sorted(map(tuple, licenses.scan(df, **how).collect()))
    want = rows()
    assert want
    assert rows(prefilter=False) == want


def test_many_templates_take_several_passes(spark, documents, monkeypatch):
    df = spark.createDataFrame([(d, t) for d, t, *_ in documents], "doc_id long, text string")
    want = sorted(map(tuple, licenses.scan(df).collect()))
    monkeypatch.setattr(licenses, "MOST", 4)
    assert sorted(map(tuple, licenses.scan(df).collect())) == want


def test_part_of_a_template(spark):
    words = licenses.TEMPLATES["MIT"].split()
    k = next(i for i, (name) in enumerate(licenses.TEMPLATES) if name == "MIT")
    assert k >= 0
    got = found(spark, [" ".join(words[: int(len(words) * 0.9)]), " ".join(words[: int(len(words) * 0.7)])])
    assert got == {(0, "MIT")}


def test_odd_texts(spark):
    assert found(spark, [None, "", "   \n", "Released under the MIT", "Released\n under, the\tMIT LICENSE!"]) == {(4, "MIT-notice")}
    row = licenses.scan(spark.createDataFrame([(1, "x y Released under the MIT License. z", 5)], "doc_id long, text string, license int")).first()
    assert (row["first_word"], row["last_word"], row["containment"]) == (2, 6, 1.0)
    df = spark.createDataFrame([(None, "Released under the MIT License.")] * 2, "doc_id long, text string")
    assert licenses.scan(df).count() == 2
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df, {}).count() == 0


def test_a_very_long_text(spark):
    text = "word " * 200_000 + "Licensed under CC BY-NC 4.0."
    assert found(spark, [text]) == {(0, "CC-BY-NC-4.0-notice")}
