"""A training-corpus pipeline out of the corpus operators: each stage reads what the one before has written.

quality rules -> line dedup -> SimHash near-dedup -> mixing sources to target weights -> best-fit packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.common import discard, shared_dir, table
from ledgerlens.llm.linededup import dedup_lines
from ledgerlens.llm.mixing import mixed
from ledgerlens.llm.packing import pack
from ledgerlens.llm.quality import passing
from ledgerlens.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and are no outliers of their language and source."""
    return passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without the lines of repeated three-line windows."""
    return dedup_lines(docs, count=False)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Bin completion and the robust estimates can't be told in SQL: tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents; what lies between is written to the shared folder, and deleted once the next stage is.

    An empty table gives an empty result; what each stage makes of nulls, empty and repeated rows its operator says. The documents'
    other columns are carried along up to the last stage.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before is not None:
            discard(before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)  # packing has written all pieces by now
    return out
