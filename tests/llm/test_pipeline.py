import corpus_pipeline
import pytest
from plain import SF, dedup_lines, fingerprint, near_prints

from ledgerlens.llm import bpe, mixing, packing, quality


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before and after each stage, written and read again."""
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, SF).write.parquet(str(top / name))
        docs = spark.read.parquet(str(top / name))
        out.append(docs)
    return out


def test_stages(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
    for df in stages[:-1]:
        assert df.columns == stages[0].columns


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_stage(stages):
    kept = {r["doc_id"] for r in quality.judge(stages[0]).filter("kept").collect()}
    assert by_id(stages[1]) == {k: v for k, v in by_id(stages[0]).items() if k in kept}


def test_line_stage(stages):
    want = dedup_lines([(r["doc_id"], r["text"]) for r in stages[1].collect()])
    got = by_id(stages[2])
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_near_duplicate_stage(stages):
    rows = sorted(stages[2].collect(), key=lambda r: r["doc_id"])
    seen, want = set(), []
    for r, c in zip(rows, near_prints([fingerprint(r["text"]) for r in rows]), strict=True):
        if c not in seen:
            want.append(r)
            seen.add(c)
    assert sorted(stages[3].collect(), key=lambda r: r["doc_id"]) == want


def test_mixing_stage(stages):
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(stages[3]).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in stages[4].groupBy("doc_id").count().collect()} == want


def test_packing_stage(stages):
    n = packing.ids(bpe.vocabulary("word_bpe_49k.json"))
    want = sorted((r["doc_id"], len(n.of(r["text"])) // 4 + 1) for r in stages[4].collect())
    got = {}
    for r in stages[5].collect():
        got.setdefault(r["doc_id"], []).append(r["length"])
    assert sum(map(sum, got.values())) == sum(k for _, k in want)
    assert sorted(got) == sorted({d for d, _ in want})


def test_run(spark, stages):
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages[5].collect()))


def test_odd_documents(spark, tmp_path, documents):
    """Nulls in every column, empty and repeated rows, and columns named like those that stages make."""
    long = [t for _, t, *_ in documents if t and len(t) > 600][:30]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(long)]
    rows += [rows[3], (None, long[0] + " with other words", None, None, None), (100, None, "en", "s", 0), (101, "", None, "s", 0), (102, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "7 AS n_lines", "8 AS row", "9 AS _group", "1 AS n_words", "2 AS copies")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert {(r["n_lines"], r["row"], r["_group"], r["n_words"], r["copies"]) for r in docs.collect()} == {(7, 8, 9, 1, 2)}
    ids = {r["doc_id"] for r in docs.collect()}
    assert not ids & {100, 101, 102}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == ids


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 11))
