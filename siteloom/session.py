"""The Spark session that the library expects."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app: str = "siteloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Batches that go to Python have 16 MB at most (and
    a row), so that long texts don't add up: Spark bounds them by rows only otherwise. Settings of a
    session that is already there, or of the cluster, are not overridden unless given in `conf`."""
    root = str(Path(__file__).resolve().parent.parent)
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):  # for Python workers
        os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (root, os.environ.get("PYTHONPATH")) if x)
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
