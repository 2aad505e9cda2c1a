from collections import defaultdict

from oracle import same
from plain import SF

from ledgerlens.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def test_rows_are_those_of_the_sql(spark, con):
    same(mixing.op9_mix_sources(spark, SF), con, mixing.OP9_SQL)


def test_words_come_near_their_targets(spark):
    rows = mixing.op9_mix_sources(spark, "/root/testdata/sf0.01").collect()
    again = mixing.op9_mix_sources(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    taken, target, size, largest = defaultdict(int), {}, {}, defaultdict(int)
    for r in rows:
        k = (r["source_size"], r["target"])
        taken[k] += r["taken"]
        target[k], size[k] = r["target"], r["source_size"]
        largest[k] = max(largest[k], r["size"])
        assert r["taken"] <= 2 * r["size"]
    for k in taken:
        assert target[k] <= 2 * size[k] + 1e-6
        assert abs(taken[k] - target[k]) <= largest[k]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-3


def targets(spark, sizes):
    df = spark.createDataFrame(sizes, "source string, source_size long")
    return {r["source"]: round(r["target"], 6) for r in mixing.targets(df).collect()}


def test_targets(spark):
    assert targets(spark, [("a", 100), ("b", 100), ("c", 100)]) == {"a": 200.0, "b": 166.666667, "c": 83.333333}
    assert targets(spark, [("a", 0), ("b", 10), (None, 1000)]) == {"a": 0.0, "b": 20.0, None: 1495.0}
    assert targets(spark, [("a", 0)]) == {"a": 0.0}


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b", None), (1, "a b", None), (None, None, "s"), (2, "", "s"), (3, "w " * 9, "s")], SCHEMA)
    rows = mixing.mix(df).collect()
    assert len(rows) == 5
    twice = [r["taken"] for r in rows if r["doc_id"] == 1]
    assert twice[0] == twice[1]
    assert mixing.mix(df.limit(0)).count() == 0
    out = mixing.mixed(df.selectExpr("*", "5 AS size", "6 AS copies"))
    assert out.columns == ["doc_id", "text", "source", "size", "copies"]
    n = sum(r["copies"] for r in rows)
    assert out.count() == n


def test_mixed_rows_are_those_of_the_plan(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(df).filter("copies > 0").collect()}
    got = {r["doc_id"]: r["count"] for r in mixing.mixed(df).groupBy("doc_id").count().collect()}
    assert got == want


def test_draws_are_even(spark):
    from pyspark.sql import functions as F

    m = spark.range(20_000).agg(F.avg(mixing.draw(F.col("id"), F.lit(""))), F.min(mixing.draw(F.col("id"), F.lit(""))), F.max(mixing.draw(F.col("id"), F.lit("")))).first()
    assert abs(m[0] - 0.5) < 0.01
    assert 0 < m[1] < 0.001
    assert 0.999 < m[2] < 1


def test_weights(spark):
    df = spark.createDataFrame([(i, "w " * 10, "s", float(i < 50)) for i in range(100)], SCHEMA + ", q double")
    rows = mixing.mix(df, weight="q", share=0.25).collect()
    assert sum(r["taken"] for r in rows if r["doc_id"] >= 50) == 0
    assert sum(r["taken"] for r in rows) in range(240, 261)


def test_clashing_columns_very_long_texts_and_equal_draws(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(i, "w " * (50 if i else 200_000), "s" if i % 2 else "t") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS size", "2 AS _u", "3 AS target", "4 AS copies", "5 AS _row")
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()}
    assert want == {r["doc_id"]: r["copies"] for r in mixing.mix(df.select("doc_id", "text", "source")).collect()}
    got = mixing.mixed(df)
    assert got.columns == df.columns
    assert {tuple(r)[3:] for r in got.collect()} <= {(1, 2, 3, 4, 5)}
    monkeypatch.setattr(mixing, "draw", lambda *a, **k: F.lit(0.25))  # all ranks of a source are equal: its documents are taken or left together
    for r in mixing.mix(df).groupBy("source").agg(F.count_distinct("copies").alias("n")).collect():
        assert r["n"] == 1
