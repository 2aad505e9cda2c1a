"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a temporary
    folder in local mode and a folder of the warehouse elsewhere."""
    conf = spark.sparkContext.getConf()
    if found := spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None):
        return found
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        local = conf.get("spark.master", "").partition("[")[0] == "local"
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="stages-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"
    return _own_dir[app]


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: what follows neither recomputes it nor depends
    on an executor's disk."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, bytes_per_core: int = 8 << 20) -> DataFrame:
    """A table of texts as it was read, dealt over all cores if its files hold less than `bytes_per_core` for each: a small file is often one row group,
    which one task reads, however many splits it has. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * bytes_per_core else df


def small(df: DataFrame, most: int = 50_000) -> DataFrame:
    """A staged df, marked for broadcast if it has at most `most` rows (of some numbers and names each); joined as any other table beyond that."""
    return F.broadcast(df) if df.count() <= most else df


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged DataFrame that no later plan reads."""
    for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, at)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the JVM may have ended before
            _delete(spark, path)
