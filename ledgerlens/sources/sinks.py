"""Where results go: tables, sets of tables, a text for each document, copies of files."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ordered


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """With a header; columns: which ones and in which order (those that df has)."""
    own = ordered(df, columns) if columns else df
    flat = own.select(*(F.to_json(c).alias(c) if own.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c) for c in own.columns))
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, by: Iterable[str] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_sheets(sheets: Mapping[str, DataFrame], path: str) -> dict[str, str]:
    """A workbook as a folder for each sheet; returns where each is."""
    out = {name: f"{path.rstrip('/')}/{name.replace(' ', '_')}" for name in sheets}
    for name, df in sheets.items():
        write_csv(df, out[name])
    return out


def write_workbook(sheets: Mapping[str, DataFrame], path: str, most: int = 50) -> None:
    """A real workbook on the driver, by openpyxl where it is installed: for summaries, not for corpora (a sheet ends at 1,048,576 rows, and a longer one is refused)."""
    from openpyxl import Workbook

    book = Workbook(write_only=True)
    for name, df in sheets.items():
        widths = {r["column"]: r["width"] for r in column_widths(df, most).collect()}
        sheet = book.create_sheet(name)
        for i, c in enumerate(df.columns):
            sheet.column_dimensions[chr(65 + i) if i < 26 else f"A{chr(39 + i)}"].width = widths[c]
        sheet.append(df.columns)
        n = 1
        for part in to_batches(df):
            n += len(part)
            if n > 1_048_576:
                raise ValueError(f"{name}: more rows than a sheet has")
            for row in part.itertuples(index=False):
                sheet.append([x if x is None or isinstance(x, (str, int, float, bool)) else str(x) for x in row])
    book.save(path)


def column_widths(df: DataFrame, most: int = 50) -> DataFrame:
    """column, width: the longest value or name and two more, `most` at most."""
    longest = [F.struct(F.lit(c).alias("column"), F.least(F.greatest(F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)), F.lit(len(c))) + 2, F.lit(most)).alias("width")) for c in df.columns]
    return df.agg(F.array(*longest).alias("_w")).select(F.inline("_w"))


def write_texts(docs: DataFrame, path: str, name: str = "file_name", text: str = "text") -> None:
    """One folder entry for each document, keyed by its name: files of text partitioned by it, so that equal stems of different folders, whose full names
    differ, don't overwrite each other."""
    docs.select(F.col(name).alias("name"), F.coalesce(text, F.lit("")).alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def copy_files(plan: DataFrame, target: str) -> DataFrame:
    """plan: path, dest_name. Copies each file to target/dest_name. Returns path, dest_name, target.

    Executors copy the files of shared folders (paths without a scheme, or file:), each its partition's; another task may copy a file anew, over what
    was there. Those of other file systems, which Python doesn't open, are streamed through Hadoop's, on the driver's connection file by file.
    """
    spark = plan.sparkSession
    own = plan.select("path", "dest_name", F.concat(F.lit(target.rstrip("/") + "/"), F.col("dest_name")).alias("target"))
    local = F.col("path").rlike("^(file:)?/") & F.col("target").rlike("^(file:)?/")

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def place(p: str) -> str:
            return "/" + p.removeprefix("file:").lstrip("/")

        for batch in batches:
            for a, b in zip(batch["path"], batch["target"], strict=True):
                os.makedirs(os.path.dirname(place(b)), exist_ok=True)
                part = f"{place(b)}.{uuid.uuid4().hex}"
                shutil.copyfile(place(a), part)
                os.replace(part, place(b))  # whole or not at all
            yield batch

    own.filter(local).mapInPandas(copy, own.schema).write.format("noop").mode("overwrite").save()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path
    for r in own.filter(~local).toLocalIterator():
        a, b = hadoop(r["path"]), hadoop(r["target"])
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
    return own


def page_subset(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """The pages (doc_id, page_num, ...) that were chosen (doc_id, page_num): the relation that a writer of page files takes."""
    return pages.join(chosen, ["doc_id", "page_num"], "left_semi")


def to_batches(df: DataFrame) -> Iterator[pd.DataFrame]:
    """df to a driver-side writer (a workbook, say) piece by piece."""
    names = df.columns
    held = []
    for r in df.toLocalIterator():
        held.append(tuple(r))
        if len(held) >= 10_000:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)
