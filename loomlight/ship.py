"""Sends this package to the Python workers, wherever the driver imported it from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file to the Spark application, once; Spark serves it to executors."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    _SENT.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(), "loomlight.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("loomlight", os.path.relpath(full, root)))
    sc.addPyFile(to)


def map_arrow(df: DataFrame, run, ddl: str) -> DataFrame:
    """df.mapInArrow with this package on the workers' path."""
    ship(df.sparkSession)
    return df.mapInArrow(run, ddl)
