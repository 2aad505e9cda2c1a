"""Queries do the whole job: nothing is left out that the reference has."""

from oracle import connect

from ledgerlens.operators import severity
from ledgerlens.plans import catalog, company_queries
from ledgerlens.plans.inputs import table

SF = "/root/testdata/sf0.001"


def test_full_vocabulary_has_ten_thousand_terms(spark):
    counts = company_queries._counts(spark, SF)
    n = table(spark, SF, "documents").count()
    fit = severity.vocabulary(counts, n, most=1_000_000).count()
    assert fit > 10_000
    assert catalog.queries()["vocabulary"](spark, SF).count() == 10_000


def test_full_weights_are_of_length_one_over_all_terms(spark):
    got = catalog.queries()["tfidf"](spark, SF)
    want = connect(SF).execute(catalog.oracle_sql()["tfidf"]).fetchall()
    assert got.count() == len(want)
    terms = {r["term"] for r in catalog.queries()["vocabulary"](spark, SF).collect()}
    assert {r["term"] for r in got.select("term").distinct().collect()} == terms
