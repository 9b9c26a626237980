"""Writers of tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_enriched(logs: DataFrame, path: str) -> None:
    """Enriched logs as Parquet with ZSTD, a folder for each day. The days that `logs` have
    replace those that are there, whole, and others stay: a day that is run again is there once.
    Rows are dealt by day into parts of about the session's advisory size, so that a day is
    a number of files by its bytes and a busy one more than one task."""
    rows = logs.withColumn("log_date", F.to_date("timestamp")).hint("rebalance", "log_date")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    writer.partitionBy("log_date").parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """A report as JSON or CSV; lists become text joined by '; ' in CSV."""
    if fmt not in ("json", "csv"):
        raise ValueError(f"unknown report format: {fmt}")
    if fmt == "csv":
        df = df.select(*[F.array_join(F.col(c).cast("array<string>"), "; ").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes])
        df.write.mode(mode).option("header", "true").csv(path)
    else:
        df.write.mode(mode).json(path)
