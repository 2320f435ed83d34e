"""Values over the earlier or later rows of a key, without gathering a key in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import staged

_HOW = {"max": F.max, "min": F.min, "sum": F.sum}
#: A key of so many rows at most may be one task's work; keys are counted together in so many groups.
WHOLE, GROUPS = 262_144, 4_096


class Over(NamedTuple):
    """A value over all earlier (or later) rows of the key: how is max, min or sum; or next, the value of the next row alone."""

    to: str
    how: str
    value: Column
    later: bool = False


def few(df: DataFrame, keys: list[str]) -> bool:
    """Whether no key has over WHOLE rows, told by the rows of all keys that share a hash: one pass that shuffles GROUPS counts a task."""
    n = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).alias("g")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (n or 0) <= WHOLE


def over_others(df: DataFrame, keys: list[str], order: list[str], bucket: Column, *values: Over, whole: bool = False) -> DataFrame:
    """df with each value's `to`; null where there is no earlier (later) row.

    `order` must be total in a key and `bucket` must not fall along it. A key's rows are dealt over its buckets: the
    buckets' own values (combined before the shuffle) are accumulated in one small window, and each bucket's rows in
    another, so a key with a third of all rows is many tasks' work. All values take one pass, over a staged copy of df,
    as it is read for the buckets and for the rows. Keys must not be null. With `whole`, which says that keys are `few` rows
    each, a key's rows are one window of one task, and nothing is staged."""
    columns = df.columns
    if whole:
        return df.select("*", *(_in_window(v, keys, order).alias(v.to) for v in values))
    # the next row is the first of all later ones
    nexts, values = values, [v._replace(value=F.struct(*order, v.value.alias("_next_value")), how="min", later=True) if v.how == "next" else v for v in values]
    df = staged(df.select("*", bucket.alias("_bucket"), *(v.value.alias(f"_v{k}") for k, v in enumerate(values))), "ordered")
    totals = df.groupBy(*keys, "_bucket").agg(*(_HOW[v.how](f"_v{k}").alias(f"_t{k}") for k, v in enumerate(values)))

    def over(part: list[str], by: list[str], later: bool) -> Window:
        sign = (lambda c: F.col(c).desc()) if later else F.col
        return Window.partitionBy(*part).orderBy(*map(sign, by)).rowsBetween(Window.unboundedPreceding, -1)

    base = totals.select(*keys, "_bucket", *(_HOW[v.how](f"_t{k}").over(over(keys, ["_bucket"], v.later)).alias(f"_b{k}") for k, v in enumerate(values)))
    inside = df.select("*", *(_HOW[v.how](f"_v{k}").over(over([*keys, "_bucket"], order, v.later)).alias(f"_o{k}") for k, v in enumerate(values)))
    both = inside.join(base, [*keys, "_bucket"])

    def found(k: int, how: str) -> Column:
        own, before = F.col(f"_o{k}"), F.col(f"_b{k}")
        if how == "sum":
            return F.coalesce(own + before, own, before)
        return (F.array_max if how == "max" else F.array_min)(F.filter(F.array(own, before), lambda x: x.isNotNull()))

    got = lambda k, v: found(k, values[k].how)["_next_value"] if v.how == "next" else found(k, v.how)
    return both.select(*columns, *(got(k, v).alias(v.to) for k, v in enumerate(nexts)))


def _in_window(v: Over, keys: list[str], order: list[str]) -> Column:
    along = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() if v.later and v.how != "next" else F.col(c) for c in order))
    return F.lead(v.value).over(along) if v.how == "next" else _HOW[v.how](v.value).over(along.rowsBetween(Window.unboundedPreceding, -1))


def carried(df: DataFrame, keys: list[str], order: list[Column], start: Callable[[], Any], step: Callable[[Any, dict], Iterable[tuple]], schema: str, parts: int | None = None) -> DataFrame:
    """What `step` gives for each row of a key in order, given a state of its own that `start` makes and `step` changes.

    Rows stream through a task in Arrow batches; a task holds one batch and one key's state, never a key's rows. Keys are
    dealt over tasks by hash, so a key should be a transcript, a clip or the like; over `parts` tasks, if a row is more work than its
    bytes tell."""
    dealt = df.repartition(*([parts] if parts else []), *keys).sortWithinPartitions(*keys, *order)
    out = StructType.fromDDL(schema)
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, key, state = to_arrow_schema(out), None, None
        for b in batches:
            rows = []
            for row in b.to_pylist():
                own = tuple(row[k] for k in keys)
                if state is None or own != key:
                    key, state = own, start()
                rows += step(state, row)
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return dealt.mapInArrow(run, schema)
