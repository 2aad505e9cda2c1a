from pyspark.sql import functions as F

from ledgerlens.plans.inputs import LEXICON
from ledgerlens.streaming import ingest


def test_tone_of_arriving_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("the water and the policy")
    out = str(tmp_path / "out")
    stream = ingest.tone_stream(ingest.arriving_texts(spark, str(tmp_path / "in")), LEXICON)

    def each(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    for name in ("a", "b"):
        if name == "b":
            (tmp_path / "in/b.txt").write_text("nothing here")
        q = ingest.start(stream, each, str(tmp_path / "check"))
        assert q.awaitTermination(60)
    got = {r["filename"]: (r["total_words"], r["LM_Positive"]) for r in spark.read.parquet(out).collect()}
    assert got == {"a": (5, 2), "b": (2, 0)}


def test_windowed_counts(spark, tmp_path):
    rows = spark.createDataFrame([("the water", "2024-01-01 00:01:00"), ("the sea", "2024-01-01 00:02:00"), ("x", "2024-01-01 05:00:00")], "text string, at string").select("text", F.to_timestamp("at").alias("arrived"))
    rows.write.parquet(str(tmp_path / "in"))
    counts = ingest.windowed_counts(ingest.arriving_rows(spark, rows, str(tmp_path / "in")), ["the"])
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted((r["texts"], r["hits"]) for r in spark.table("counts").collect()) == [(1, 0), (2, 2)]
