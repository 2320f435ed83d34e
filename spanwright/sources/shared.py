"""Tables of a folder, and places that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """Below the folder in spark.checkpoint.dir. Where that is unset, below a new temporary one on a local master (tests); a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spanwright-")
    return f"{found.rstrip('/')}/spanwright/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """df written as Parquet into the shared folder and read back: what is read more than once is worked out once, and
    survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
