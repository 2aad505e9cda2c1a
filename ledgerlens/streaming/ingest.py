"""Tone metrics of texts as they arrive in a folder. What is told of one document alone runs on a stream as it is."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.text import tone_tokens
from ..operators import tone
from ..sources.files import file_name


def arriving_texts(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of path, file_name, text, arrived (the file's time): one row for each new file."""
    stream = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(root)
    path = F.col("_metadata.file_path")
    return stream.select(path.alias("path"), file_name(path).alias("file_name"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("arrived"))


def arriving_rows(spark: SparkSession, like: DataFrame, root: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet rows with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(root)


def tone_stream(texts: DataFrame, lexicon: Mapping[str, Iterable[str]], **how) -> DataFrame:
    """The tone schema of each arriving text."""
    return tone.tone_metrics(texts, lexicon, name=N.stem(F.col("file_name")), **how)


def windowed(stream: DataFrame, time: str, keys: list[str], *aggregates: Column, width: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Aggregates by window of event time and keys; rows later than the watermark are left out, and the state of windows past it is dropped."""
    own = stream.withWatermark(time, late)
    return own.groupBy(F.window(time, width, slide) if slide else F.window(time, width), *keys).agg(*aggregates)


def windowed_counts(texts: DataFrame, words: Iterable[str], time: str = "arrived", width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """By window of time: texts, and tokens among `words`. Texts later than the watermark are left out."""
    known = F.array(*(F.lit(w) for w in sorted(set(words))))
    hits = F.size(F.filter(tone_tokens("text", ()), lambda t: F.array_contains(known, t))).cast("long")
    own = texts.select(F.col(time).alias("at"), hits.alias("hits"))
    return windowed(own, "at", [], F.count("*").alias("texts"), F.sum("hits").alias("hits"), width=width, late=late)


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Runs `each` on every batch; once: what has arrived so far, then ends. A batch that is run again after a failure has the same number."""
    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")).start()
