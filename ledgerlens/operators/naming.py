"""Names of files that are brought together in one folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import stem, suffix
from ..sources.staging import staged


def numbered(files: DataFrame, name: str = "file_name", order: str = "path", mark: str = "_", into: str = "dest_name") -> DataFrame:
    """files with a destination name that no other row has: of equal names the first by `order` keeps it, others get mark and a number.

    Ranks are counted by name and range of `order`, and shifted by the ranges before, so that a name that many files share is no single task.
    Where such a name is another file's own, the next free number is taken: a number is put up by as many as the taken ones of its name that
    come before it, which a running maximum over both, in order, tells. Only the rows of such names take part in that.
    """
    c = F.col(name)
    made = lambda n: F.when(n == 0, c).otherwise(F.concat(stem(c), F.lit(mark), n.cast("string"), suffix(c)))
    # written, so that the ranges are the same wherever they are read
    dealt = staged(files.repartitionByRange(name, order).withColumn("_range", F.spark_partition_id()))
    before = dealt.groupBy(name, "_range").agg(F.count("*").alias("_rows"))
    before = before.select(F.col(name).alias("_name"), F.col("_range").alias("_at"), (F.sum("_rows").over(Window.partitionBy(name).orderBy("_range")) - F.col("_rows")).alias("_shift"))
    nth = F.row_number().over(Window.partitionBy(name, "_range").orderBy(order)) - 1
    own = dealt.withColumn("_nth", nth).join(before, F.col(name).eqNullSafe(F.col("_name")) & (F.col("_range") == F.col("_at")))
    own = own.withColumn("_n", F.col("_nth") + F.col("_shift")).drop("_name", "_range", "_at", "_rows", "_shift", "_nth")
    # numbers that a file's own name has already: the j-th of a name, u, puts up all from u - j + 1 on by j
    taken = files.select(c.alias("_taken")).distinct()
    clash = taken.withColumn("_of", F.regexp_replace("_taken", rf"{_quoted(mark)}\d+(\.[^.]*)?$", "$1")).withColumn("_no", F.regexp_extract("_taken", rf"{_quoted(mark)}(\d{{1,9}})(?:\.[^.]*)?$", 1))
    used = clash.filter("_no <> '' and not startswith(_no, '0')").select("_of", F.col("_no").cast("long").alias("_no")).distinct()
    used = staged(used.join(own.filter("_n > 0").select(c.alias("_of")).distinct(), "_of", "left_semi"))
    used = used.withColumn("_up", F.row_number().over(Window.partitionBy("_of").orderBy("_no"))).select("_of", (F.col("_no") - F.col("_up") + 1).alias("_at"), "_up")
    hit = own.join(used.select("_of").distinct(), F.col(name) == F.col("_of"), "left_semi").filter("_n > 0")
    free = own.join(used.select("_of").distinct(), F.col(name) == F.col("_of"), "left_anti").unionAll(own.join(used.select("_of").distinct(), F.col(name) == F.col("_of"), "left_semi").filter("_n = 0"))
    rows = hit.select(c.alias("_of"), F.col("_n").cast("long").alias("_at"), F.lit(0).alias("_up"), F.struct(*own.columns).alias("_row"))
    both = used.unionByName(rows, allowMissingColumns=True)
    # at one place the taken number comes before the rows
    put_up = F.max("_up").over(Window.partitionBy("_of").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    moved = both.withColumn("_by", put_up).filter("_row is not null").select("_row.*", "_by")
    done = free.withColumn("_by", F.lit(0)).unionByName(moved)
    return done.withColumn(into, made(F.col("_n") + F.col("_by"))).drop("_n", "_by")


def _quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def copy_plan(files: DataFrame, renamed: Column | None = None, mark: str = "_") -> DataFrame:
    """files: path, file_name. path and dest_name of every copy; renamed: the name before numbering (the file's own, if none is given)."""
    own = files.select("path", (F.col("file_name") if renamed is None else renamed).alias("file_name"))
    return numbered(own, mark=mark).select("path", "dest_name")
