"""Sends the package to Python workers that were not started beside it."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def _archive(root: str) -> str:
    package = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="spark-package-"), "tidepanel.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    return out


def ship(root: str, query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, which first makes sure once per application that workers can import this package."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        reachable = root in os.environ.get("PYTHONPATH", "").split(os.pathsep)
        if app not in _sent and not reachable:
            spark.sparkContext.addPyFile(_archive(root))  # the driver serves the file to all executors
        _sent.add(app)
        return query(spark, sf_dir)

    return run
