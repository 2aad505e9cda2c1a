"""The logical inputs of the queries, told in terms of the driver's tables, for Spark and for DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import spread

#: A lexicon whose words occur in the documents; Stop overlaps with the others on purpose.
LEXICON = {
    "Positive": ["the", "that", "with", "des", "und"],
    "Negative": ["and", "der", "was", "que"],
    "Uncertainty": ["for", "this", "thatin"],
    "Litigious": ["die", "les", "license"],
    "Strong": ["are", "ing"],
    "Weak": ["from", "tion", "rewh"],
    "Constraining": ["orre", "ble"],
    "Complexity": ["hehely", "orantion"],
    "Stop": ["des", "von", "mit", "pour"],
}
ESG_WORDS = ["the", "inoran", "ononst", "sich", "del"]
#: word, polarity, subjectivity.
POLARITY = [("the", 0.2, 0.1), ("that", 0.4, 0.3), ("with", 0.1, 0.2), ("der", -0.5, 0.6), ("que", -0.2, 0.9), ("les", 0.7, 0.5), ("license", -0.9, 1.0)]


#: Tables of texts, whose rows cost much more than moving them.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in TEXTS else found


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as report files: file_name like src3_Annual Report_2021-22_17.txt."""
    y = F.col("doc_id") % 5 + 2018
    name = F.concat(F.col("source"), F.lit("_Annual_Report_"), y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", name.alias("file_name"))


FILES_SQL = "SELECT doc_id, text, lang, source, source || '_Annual_Report_' || (doc_id % 5 + 2018) || '-' || lpad(((doc_id % 5 + 2019) % 100)::VARCHAR, 2, '0') || '.txt' AS file_name FROM documents"


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as report pages: a conversation is a document, a turn is a page; every third page is landscape."""
    c = table(spark, sf_dir, "conversations")
    wide = F.col("turn") % 3 == 0
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_num"), "text", F.when(wide, 842.0).otherwise(595.0).alias("width"), F.when(wide, 595.0).otherwise(842.0).alias("height"))


PAGES_SQL = "SELECT conv_id AS doc_id, turn::INT AS page_num, text, CASE WHEN turn % 3 = 0 THEN 842.0 ELSE 595.0 END::DOUBLE AS width, CASE WHEN turn % 3 = 0 THEN 595.0 ELSE 842.0 END::DOUBLE AS height FROM conversations"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def sql_in(words) -> str:
    return "(" + ", ".join(quoted(w) for w in sorted(set(words))) + ")"
