"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, which only a session on this machine alone may use."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tallyline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_ROOTS: dict[tuple[str, str], str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of our own (nothing is there yet) below the shared folder; all of them go when the driver ends."""
    shared = shared_dir(spark)
    key = (spark.sparkContext.applicationId, shared)
    if key not in _ROOTS:
        root = f"{shared}/tallyline-{uuid.uuid4().hex}"
        there = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        files.mkdirs(there)
        files.deleteOnExit(there)
        _ROOTS[key] = root
    return f"{_ROOTS[key]}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
