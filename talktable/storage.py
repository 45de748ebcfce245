"""Where intermediate tables go when a plan has to be cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only for local masters."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and read it back.

    Parquet rather than an RDD checkpoint: the reader knows the size on disk, so a small
    table (centroids, counts) is broadcast and a large one is not.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/talktable/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

