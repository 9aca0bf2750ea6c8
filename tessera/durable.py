"""Intermediate tables that survive lost executors: written to the cluster's shared folder, then read back."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, deleted when Python ends."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{top.rstrip('/')}/tessera-graph/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df with its lineage cut: a Parquet table under spark.checkpoint.dir; where that is unset, a temporary folder
    serves a local session and a cluster is refused."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            return
