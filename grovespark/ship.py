"""Bring this package to the executors' Python workers."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources along with the application's files, once for each application.

    Needed where the package is not installed on the executors; Spark's own file
    server hands the archive out.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "grovespark.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def by_value(module: str) -> None:
    """Pickle what a module defines with its code: planners of sources and of stateful streams don't get the shipped archive."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
