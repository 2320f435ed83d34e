"""Envelopes of sampled signals: rows of (keys..., i long from 0, x double)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Over, over_others


def rms_per_hop(samples: DataFrame, keys: list[str], hop: int) -> DataFrame:
    """Root mean square of each hop; the last one is divided by its own size."""
    return samples.groupBy(*keys, F.floor(F.col("i") / hop).alias("hop")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))


def bucket_max_carried(samples: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Maximum of each bucket; a bucket of zero takes the last that isn't, through any number of zeros."""
    top = samples.groupBy(*keys, F.floor(F.col("i") / size).alias("b")).agg(F.max("x").alias("x"))
    value = F.when(F.col("x") != 0, F.struct("b", "x"))
    top = over_others(top, keys, ["b"], F.floor(F.col("b") / 4096), Over("_last", "max", value))
    return top.select(*keys, "b", F.when(F.col("x") != 0, F.col("x")).otherwise(F.coalesce("_last.x", F.lit(0.0))).alias("x"))


def max_pool(samples: DataFrame, keys: list[str], out: int) -> DataFrame:
    """(keys, b, x): maxima of `out` buckets whose edges are floor(k * n / out); n <= out stays as it is, the rest zero."""
    sized = samples.join(samples.groupBy(*keys).agg((F.max("i") + 1).alias("_n")), keys)
    bucket = F.when(F.col("_n") <= out, F.col("i")).otherwise(F.expr(f"((i + 1) * {out} + _n - 1) div _n - 1"))
    found = sized.groupBy(*keys, bucket.cast("long").alias("b")).agg(F.max("x").alias("x"))
    every = samples.select(*keys).distinct().withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(out - 1).cast("long"))))
    return every.join(found, [*keys, "b"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))


def quantized(pooled: DataFrame, keys: list[str], top: int = 127) -> DataFrame:
    """x scaled so that its 99th percentile (the maximum, if that is zero) is `top`, in whole numbers from 0 to top."""
    ref = pooled.groupBy(*keys).agg(F.percentile("x", F.lit(0.99)).alias("p"), F.max("x").alias("m"))
    ref = ref.select(*keys, F.when(F.col("p") > 0, F.col("p")).otherwise(F.col("m")).alias("_ref"))
    level = F.when(F.col("_ref") > 0, F.bround(F.col("x") * (top / F.col("_ref")), 0)).otherwise(0)
    return pooled.join(ref, keys).select(*keys, "b", F.least(F.lit(top), F.greatest(F.lit(0), level)).cast("int").alias("level"))


def audible_end(samples: DataFrame, keys: list[str], above: float = 0.004) -> DataFrame:
    """One past the last sample over `above` in size; without one, the length."""
    got = samples.groupBy(*keys).agg(F.max(F.when(F.abs("x") > above, F.col("i") + 1)).alias("e"), (F.max("i") + 1).alias("n"))
    return got.select(*keys, F.coalesce("e", "n").alias("end_i"))


def residual_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean and population deviation of what isn't null."""
    x: Column = F.col(value)
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("deviation"))
