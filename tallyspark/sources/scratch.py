"""Folders for tables and files that a query writes for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A path that does not exist yet, in the folder that the driver and all executors share.

    Where a local master names none, as in tests, it is below a new local one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
    return f"{root.rstrip('/')}/tallyspark-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as a table of files: computed once, and read again where an executor is lost."""
    spark, schema = df.sparkSession, df.schema
    folder = folder or new_folder(spark)
    df.write.mode("overwrite").parquet(folder)
    return spark.read.schema(schema).parquet(folder)
