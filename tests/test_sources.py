import os
import random

import pytest
from oracle import rows_of
from pyspark.sql import functions as F

from ledgerlens.functions import vocabulary as V
from ledgerlens.sources import files, lexicons, sinks
from ledgerlens.sources.engines import plain_engine


def put(root, names):
    for name, content in names.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(root)


def names(df):
    return sorted(r["file_name"] for r in df.collect())


def test_listings(spark, tmp_path):
    root = put(tmp_path, {"a.pdf": "x", "b.PDF": "x", "c.Pdf": "x", "d.txt": "x", "s/e.pdf": "x", "s/f.PDF": "x", "s/t/g.pdf": "x", "h_2024-25.pdf": "x"})
    assert names(files.listing(spark, root)) == ["a.pdf", "h_2024-25.pdf"]
    assert names(files.listing(spark, root, recursive=True, both_cases=True)) == ["a.pdf", "b.PDF", "e.pdf", "f.PDF", "g.pdf", "h_2024-25.pdf"]
    assert names(files.one_level(spark, root)) == ["e.pdf", "f.PDF"]
    assert names(files.ending(files.listing(spark, root), "_2024-25.pdf")) == ["h_2024-25.pdf"]


def test_decoding(spark, tmp_path):
    root = put(tmp_path, {"a.txt": b"caf\xe9", "b.txt": "café"})
    read = lambda how: {r["file_name"]: r["text"] for r in files.read_texts(spark, root, how).collect()}
    assert read("ignore") == {"a.txt": "caf", "b.txt": "café"}
    assert read("replace") == {"a.txt": "caf�", "b.txt": "café"}
    assert read("cascade") == {"a.txt": "café", "b.txt": "café"}
    with pytest.raises(Exception, match="(?i)utf"):
        read("strict")


def test_pages_and_errors(spark, tmp_path):
    root = put(tmp_path, {"a.pdf": "one\ftwo", "b.pdf": "bad"})

    def engine(content):
        if content == b"bad":
            raise ValueError("broken")
        yield from plain_engine(content)

    pages = files.read_pages(spark.read.format("binaryFile").load(root), engine)
    got = sorted((r["path"][-5:], r["page_num"], r["text"], r["error"]) for r in pages.collect() if r["error"] is None)
    assert got == [("a.pdf", 0, "one", None), ("a.pdf", 1, "two", None)]
    assert [r["error"] for r in pages.collect() if r["error"]] == ["ValueError: broken"]
    assert sorted((r["path"][-5:], r["text"]) for r in files.whole_text(pages).collect()) == [("a.pdf", "onetwo"), ("b.pdf", "")]
    assert [r["text"] for r in files.whole_text(pages, end=" ").collect() if r["text"]] == ["one two "]


def test_columns(spark):
    df = spark.createDataFrame([("A",), (None,)], "Symbol string")
    assert rows_of(files.column_values(df, "Symbol")) == [("A",)]
    with pytest.raises(ValueError, match="Symbol"):
        files.column_values(df, "Ticker")


def words(spark, dialect):
    lines = spark.createDataFrame([("; c",), ("Gain good",), ("x1",), ("",), (" ; d",), ("#e",), (None,)], "value string")
    return {r["word"] for r in lexicons.words_of(lines, **lexicons.DIALECTS[dialect]).collect()}


def test_list_dialects(spark):
    assert words(spark, "category") == {"gain"}
    assert words(spark, "list") == {"gain good", "x1", "; d"}
    assert words(spark, "stopwords") == {"gain good", "x1", "#e"}
    assert words(spark, "inline") == {"; c", "gain good", "x1", "; d"}


def test_master_tables(spark):
    rows = [("GOOD", "2009", "0"), ("bad", "0", "-2020"), ("odd", "", "0.0"), ("x1", "1", "1"), (None, "1", "1")]
    t = spark.createDataFrame(rows, "word string, POSITIVE string, NegativeFlag string")
    assert sorted(rows_of(lexicons.master_words(t))) == [("Negative", "bad"), ("Negative", "odd"), ("Positive", "good")]
    assert sorted(rows_of(lexicons.master_words(t, numeric=True))) == [("Negative", "bad"), ("Positive", "good")]
    both = lexicons.merge(lexicons.master_words(t), spark.createDataFrame([("Positive", "good"), ("Stop", "a")], "category string, word string"))
    assert lexicons.as_sets(both) == {"Negative": ["bad", "odd"], "Positive": ["good"], "Stop": ["a"]}
    with pytest.raises(ValueError, match="entries"):
        lexicons.as_sets(both, 1)
    assert lexicons.find_column(["a", "LM_Positive"], "positive") == "LM_Positive"


def test_load_words(spark, tmp_path):
    root = put(tmp_path, {"w.txt": "Good thing\n;no\n"})
    assert rows_of(lexicons.load_words(spark, f"{root}/w.txt")) == [("good",)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2], 3)], "name string, pages array<int>, n int")
    out = sinks.write_sheets({"All rows": df}, str(tmp_path / "book"))
    back = spark.read.option("header", True).option("escape", '"').csv(out["All rows"])
    assert rows_of(back) == [("a", "[1,2]", "3")]
    sinks.write_csv(df, str(tmp_path / "one"), ["n", "name", "none"])
    assert spark.read.option("header", True).csv(str(tmp_path / "one")).columns == ["n", "name"]
    assert rows_of(sinks.column_widths(df.select("name", "n"))) == [("name", 6), ("n", 3)]
    sinks.write_parquet(df, str(tmp_path / "p"), ["name"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    sinks.write_texts(spark.createDataFrame([("x/a", "t"), ("y/a", None)], "file_name string, text string"), str(tmp_path / "t"))
    assert len(os.listdir(tmp_path / "t")) >= 2
    assert [len(b) for b in sinks.to_batches(df)] == [1]


def test_copies(spark, tmp_path):
    root = put(tmp_path / "in", {"s/a.txt": "1", "t/a.txt": "2"})
    plan = spark.createDataFrame([(f"{root}/s/a.txt", "a.txt"), (f"{root}/t/a.txt", "a_1.txt")], "path string, dest_name string")
    sinks.copy_files(plan, str(tmp_path / "out"))
    assert (tmp_path / "out/a_1.txt").read_text() == "2"


def test_page_subset(spark):
    pages = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, page_num int, text string")
    assert rows_of(sinks.page_subset(pages, spark.createDataFrame([(1, 1)], "doc_id long, page_num int"))) == [(1, 1, "b")]


def test_fixed_values_are_whole():
    assert len(V.SECTION_PATTERNS) == 14
    assert len(V.FINANCIAL_PATTERNS) == 13


def test_folder_of_the_suffix_is_one_file(spark, tmp_path):
    for at in ("a.parquet", "whole.parquet/part-0000.parquet", "whole.parquet/_SUCCESS", "whole.parquet/day=1/part-1", "deep/whole.PARQUET/part-0000.parquet", "deep/b.txt", "c.txt"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_bytes(b"12345")
    rows = lambda df: sorted((r["path"].rpartition(f"{tmp_path}/")[2], r["file_name"], r["length"]) for r in df.collect())
    top = [("a.parquet", "a.parquet", 5), ("whole.parquet", "whole.parquet", 10)]
    assert rows(files.listing(spark, str(tmp_path), "parquet")) == top
    assert rows(files.listing(spark, str(tmp_path), "parquet", recursive=True, both_cases=True)) == [*top[:1], ("deep/whole.PARQUET", "whole.PARQUET", 5), *top[1:]]


def test_decoders_are_pythons_and_need_none(spark):
    """Random bytes, valid, broken and of code pages, are read as Python reads them, by plans without a Python step."""
    pieces = [b"\x01", b"a", b"b", "�".encode(), "é€😀".encode(), b"\xff", b"\xef\xbf", b"\xed\xa0\x80", b"\xc0\x80", b"\xf0\x9f\x98", b"\xf4\x90\x80\x80", b"\x80", b"\x81", b"\x9d", b"\xe9", b"\xe2\x82"]
    rnd = random.Random(7)
    blobs = [bytes(range(256)), b"", None, *(b"".join(rnd.choices(pieces, k=rnd.randint(1, 7))) for _ in range(3000))]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "i int, b binary").select("i", *(files.DECODERS[k](F.col("b")).alias(k) for k in ("ignore", "cascade")))

    def cascade(b):
        for e in ("utf-8", "cp1252"):
            try:
                return b.decode(e)
            except UnicodeDecodeError:
                continue
        return b.decode("latin-1")

    assert rows_of(df.orderBy("i")) == [(i, *(b if b is None else f(b) for f in (lambda x: x.decode("utf-8", "ignore"), cascade))) for i, b in enumerate(blobs)]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
