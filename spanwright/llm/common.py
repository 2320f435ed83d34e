"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it, for Java regular expressions.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a new temporary one on a local master (tests); a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spanwright-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The folder below the shared one for what is staged just now.
_FOLDER: ContextVar[str] = ContextVar("folder", default="")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_FOLDER.get() or shared_dir(spark) + '/spanwright'}/{uuid.uuid4().hex}/{name}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged in the block goes to one folder, which is deleted behind it: the block has to write its result elsewhere."""
    folder = new_path(spark, "scratch")
    token = _FOLDER.set(folder)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts lineage, survives lost executors, and lets Spark size later joins by the files' true size."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_names(df: DataFrame, *names: str) -> list[str]:
    """Column names beginning with these that df doesn't have, in any case."""
    own, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in own:
            name += "_"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a task holds few texts as Python objects at once."""
    for b in batches:
        for k in range(0, max(1, b.num_rows), rows):
            yield b.slice(k, rows)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns cannot clash; a null text is empty."""
    return docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"))


def sized(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches whose strings in `column` have at most so many bytes, unless one row has more."""
    for b in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(b.column(b.schema.get_field_index(column))).fill_null(0)), dtype=np.int64)
        k = 0
        while k < b.num_rows:
            end = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most, side="right")))
            yield b.slice(k, end - k)
            k = end
