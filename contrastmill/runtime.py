"""Session helpers shared by the plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_directory(spark: SparkSession) -> str:
    """The folder for written intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``; in local mode, where one
    machine holds everything, a temporary folder serves when the setting is absent.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="contrastmill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that lost executors cost a re-read rather than a re-count, and gives
    Catalyst the true size of the table, so that it alone decides what may be broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_directory(spark)}/contrastmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
