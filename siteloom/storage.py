"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one named in spark.checkpoint.dir. Only where that is unset, and the
    master is local, is a temporary folder made; otherwise the warehouse is used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_siteloom"
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="siteloom-"))
    return _local[0]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own; what an application leaves is under one folder, named by its id."""
    return f"{shared_dir(spark)}/siteloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: the lineage ends
    here, and a lost executor costs nothing that was finished before."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark's file systems reach it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Rounds:
    """The tables of a loop. A round is computed from the one before, so that once it is
    written, older ones are deleted."""

    def __init__(self, tag: str):
        self.tag, self.paths = tag, []

    def write(self, df: DataFrame) -> DataFrame:
        spark, path = df.sparkSession, new_path(df.sparkSession, self.tag)
        df.write.parquet(path)
        self.paths.append(path)
        if len(self.paths) > 2:
            delete(spark, self.paths.pop(0))
        return spark.read.schema(df.schema).parquet(path)
