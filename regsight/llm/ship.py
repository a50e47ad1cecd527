"""Send the package to the executors' Python workers (what ``--py-files`` does)."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import regsight

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add this package to the session's Python files, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(regsight.__file__))
    if os.path.isdir(root):
        path = os.path.join(tempfile.mkdtemp(prefix="regsight-"), "regsight_package.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(root)))
        context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
