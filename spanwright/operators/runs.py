"""Runs of equal values and of matched positions along an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Over, over_others


def value_runs(df: DataFrame, keys: list[str], order: str, value: str, bucket: Column, more: Sequence[Column] = ()) -> DataFrame:
    """Consecutive rows of a key with one value: (keys, value, first, last, n, aggregates in `more`). `order` is distinct in a key; a null value is one of its own."""
    mark = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    rows = over_others(df if more else df.select(*keys, order, value), keys, [order], bucket, Over("_prior", "max", mark))
    opens = F.when(F.col("_prior").isNull() | ~F.col("_prior.v").eqNullSafe(F.col(value)), F.col(order))
    rows = over_others(rows.withColumn("_opens", opens), keys, [order], bucket, Over("_before", "max", F.col("_opens")))
    rows = rows.withColumn("_run", F.coalesce("_opens", "_before"))
    return rows.groupBy(*keys, "_run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), *more).drop("_run")


def hysteresis(frames: DataFrame, keys: list[str], high: float, low: float, silence_ms: int, longer_than_ms: int, bucket: Column) -> DataFrame:
    """(keys, t_ms, p) -> segments: on at p >= high; off at the first frame under `low` once frames under `low` have
    spanned silence_ms with no high one between. Kept if strictly longer than longer_than_ms; open ones end at the
    last frame.

    In sets: frames after one high frame form its group; a group closes iff its low frames span silence_ms, and
    segments are the runs of groups between closing ones."""
    is_high, is_low = F.col("p") >= high, F.col("p") < low
    rows = over_others(frames.dropna(subset=[*keys, "t_ms", "p"]), keys, ["t_ms"], bucket, Over("_prior", "max", F.when(is_high, F.col("t_ms"))))
    rows = rows.withColumn("on_ms", F.when(is_high, F.col("t_ms")).otherwise(F.col("_prior"))).filter("on_ms is not null")
    low_at = F.when(is_low, F.col("t_ms"))
    groups = rows.groupBy(*keys, "on_ms").agg(F.min(low_at).alias("off_ms"), F.max(low_at).alias("low_ms"), F.max("t_ms").alias("last_ms"))
    groups = groups.withColumn("t_ms", F.col("on_ms")).withColumn("closes", F.coalesce(F.col("low_ms") - F.col("off_ms") >= silence_ms, F.lit(False)))
    groups = over_others(groups, keys, ["t_ms"], bucket, Over("_closed", "max", F.when(F.col("closes"), F.col("t_ms"))))
    found = groups.groupBy(*keys, "_closed").agg(F.min("on_ms").alias("start_ms"), F.max(F.struct("on_ms", F.when(F.col("closes"), F.col("off_ms")).otherwise(F.col("last_ms")).alias("e")))["e"].alias("end_ms"))
    return found.filter(F.col("end_ms") - F.col("start_ms") > longer_than_ms).drop("_closed")


def energy_segments(levels: DataFrame, keys: list[str], hop_ms: int = 30, on_share: float = 0.10, off_share: float = 0.04, hang_ms: int = 150, least_ms: int = 250, hops_per_bucket: int = 100_000) -> DataFrame:
    """(keys, hop, rms) -> segments: on at a level over max(0.001, on_share of the key's peak); off where levels of
    max(0.0005, off_share of the peak) or less begin that last hang_ms or more. Segments under least_ms are left out;
    an open one ends with the last hop; a key without any level over zero has none. `hop` is distinct in a key.

    In sets: quiet runs of hang_ms are breaks; between two breaks a segment reaches from the first hop that is on to
    the second break."""
    rows = levels.select(*keys, "hop", "rms").dropna()
    peaks = rows.groupBy(*keys).agg(F.max("rms").alias("_peak")).filter("_peak > 0")
    rows = rows.join(peaks, keys).withColumn("_quiet", F.col("rms") <= F.greatest(F.lit(0.0005), off_share * F.col("_peak")))
    rows = rows.withColumn("_on", F.when(F.col("rms") > F.greatest(F.lit(0.001), on_share * F.col("_peak")), F.col("hop")))
    runs = value_runs(rows, keys, "hop", "_quiet", F.floor(F.col("hop") / hops_per_bucket), [F.min("_on").alias("_on")])
    is_break = F.col("_quiet") & (F.col("n") * hop_ms >= hang_ms)
    runs = over_others(runs, keys, ["first"], F.floor(F.col("first") / hops_per_bucket), Over("_prior", "max", F.when(is_break, F.col("last"))))
    found = runs.groupBy(*keys, "_prior").agg(F.min("_on").alias("s"), F.coalesce(F.min(F.when(is_break, F.col("first"))), F.max("last") + 1).alias("e"))
    found = found.select(*keys, (F.col("s") * hop_ms).alias("start_ms"), (F.col("e") * hop_ms).alias("end_ms"))
    return found.filter(F.col("end_ms") - F.col("start_ms") >= least_ms)
