"""Stages stored in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a fresh temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quoin-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def store(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, so that later stages don't compute it again and
    a lost executor costs only the tasks it ran. ``by`` names a column whose values get folders of their own."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/quoin/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)
