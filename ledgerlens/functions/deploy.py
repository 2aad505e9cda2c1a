"""Gives the package to the Python workers of a cluster that doesn't have it installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: Spark serves the archive to each worker. Needed before a Python function of this package runs on executors."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{os.path.basename(top)}.zip")  # the driver serves it for as long as it runs
    atexit.register(shutil.rmtree, os.path.dirname(archive), ignore_errors=True)
    with zipfile.ZipFile(archive, "w") as z:
        for at, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    z.write(path := os.path.join(at, name), os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
