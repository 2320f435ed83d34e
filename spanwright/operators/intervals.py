"""Algebra of intervals: rows of (keys..., start_ms long, end_ms long), half-open, times in integer milliseconds.

Rows with a null key, start or end are no intervals and are left out. BUCKET_MS deals the intervals of one key over
tasks; it does not change a result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged
from .ordered import Over, few, over_others

BUCKET_MS = 86_400_000


def _whole(spans: DataFrame, keys: list[str]) -> DataFrame:
    return spans.dropna(subset=[*keys, "start_ms", "end_ms"])


def _bucket(of: str, width: int) -> Column:
    return F.floor(F.col(of) / width)


def measured(spans: DataFrame, keys: list[str], whole: bool | None) -> tuple[DataFrame, bool]:
    """Whole intervals, and whether their keys are `few` rows each; if that is not known, they are staged and counted. Rows of few keys
    are dealt by key once, which serves all that follows."""
    if whole is None:
        spans = staged(_whole(spans, keys), "spans")
        if whole := few(spans, keys):
            spans = spans.repartition(*keys)
        return spans, whole
    return _whole(spans, keys), whole


def islands(spans: DataFrame, keys: list[str], gap_ms: int, bucket_ms: int = BUCKET_MS, whole: bool = False) -> DataFrame:
    """(keys, start_ms, end_ms, n rows) with `island_ms`, the start of the merged run that each belongs to: a run ends where the next start is
    over gap_ms past every end so far (a gap of exactly gap_ms still merges)."""
    # rows of equal start and end are alike, so counting them makes the order total
    rows = _whole(spans, keys).groupBy(*keys, "start_ms", "end_ms").agg(F.count("*").alias("n"))
    order, bucket = ["start_ms", "end_ms"], _bucket("start_ms", bucket_ms)
    rows = over_others(rows, keys, order, bucket, Over("_reach", "max", F.col("end_ms")), whole=whole)
    opens = F.when(F.col("_reach").isNull() | (F.col("start_ms") > F.col("_reach") + gap_ms), F.col("start_ms"))
    rows = rows.withColumn("_opens", opens)
    rows = over_others(rows, keys, order, bucket, Over("_before", "max", F.col("_opens")), whole=whole)
    return rows.withColumn("island_ms", F.coalesce("_opens", "_before")).drop("_reach", "_opens", "_before")


def merge(spans: DataFrame, keys: list[str], gap_ms: int = 0, least_ms: int = 0, bucket_ms: int = BUCKET_MS, whole: bool | None = None) -> DataFrame:
    """Merged runs (keys, start_ms, end_ms, n rows); runs under least_ms are left out after merging."""
    spans, whole = measured(spans.select(*keys, "start_ms", "end_ms"), keys, whole)
    runs = islands(spans, keys, gap_ms, bucket_ms, whole).groupBy(*keys, F.col("island_ms").alias("start_ms"))
    runs = runs.agg(F.max("end_ms").alias("end_ms"), F.sum("n").alias("n"))
    return runs.filter(F.col("end_ms") - F.col("start_ms") >= least_ms)


def coalesce(spans: DataFrame, keys: list[str], least_ms: int = 0, whole: bool | None = None) -> DataFrame:
    """Union of the non-empty intervals: touching ones are one."""
    return merge(spans.filter("end_ms > start_ms"), keys, 0, least_ms, whole=whole)


def union_length(spans: DataFrame, keys: list[str]) -> DataFrame:
    return coalesce(spans, keys).groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("union_ms"))


def gaps(spans: DataFrame, keys: list[str], least_ms: int, bucket_ms: int = BUCKET_MS, whole: bool | None = None) -> DataFrame:
    """Between merged runs, what lasts least_ms or longer."""
    spans, whole = measured(spans.select(*keys, "start_ms", "end_ms"), keys, whole)
    return between(merge(spans, keys, 0, 0, bucket_ms, whole), keys, least_ms, bucket_ms, whole)


def between(runs: DataFrame, keys: list[str], least_ms: int, bucket_ms: int = BUCKET_MS, whole: bool = False) -> DataFrame:
    """Between runs that are merged, what lasts least_ms or longer."""
    runs = over_others(runs, keys, ["start_ms"], _bucket("start_ms", bucket_ms), Over("_next", "next", F.col("start_ms")), whole=whole)
    return runs.filter(F.col("_next") - F.col("end_ms") >= least_ms).select(*keys, F.col("end_ms").alias("start_ms"), F.col("_next").alias("end_ms"))


def _steps(spans: DataFrame, keys: list[str], side: str) -> DataFrame:
    step = F.explode(F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("d"))))
    return spans.filter("end_ms > start_ms").select(*keys, step.alias("x")).select(*keys, "x.t", (F.col("x.d") if side == "a" else F.lit(0)).alias("a"), (F.col("x.d") if side == "b" else F.lit(0)).alias("b"))


def _both_steps(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, bool]:
    """Staged boundaries of either side, and whether their keys are few."""
    steps = staged(_steps(_whole(left, keys), keys, "a").unionByName(_steps(_whole(right, keys), keys, "b")), "steps")
    whole = few(steps, keys)
    return steps.repartition(*keys) if whole else steps, whole


def sweep(left: DataFrame, right: DataFrame, keys: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(keys, start_ms, end_ms, a, b): between neighbouring boundaries, how many of either side's intervals hold."""
    return _swept(*_both_steps(left, right, keys), keys, bucket_ms)


def _swept(steps: DataFrame, whole: bool, keys: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    steps = steps.groupBy(*keys, "t").agg(F.sum("a").alias("da"), F.sum("b").alias("db"))
    steps = over_others(steps, keys, ["t"], _bucket("t", bucket_ms), Over("a", "sum", F.col("da")), Over("b", "sum", F.col("db")), Over("_next", "next", F.col("t")), whole=whole)
    held = [(F.coalesce(d, F.lit(0)) + F.col(f"d{d}")).alias(d) for d in ("a", "b")]
    return steps.filter("_next is not null").select(*keys, F.col("t").alias("start_ms"), F.col("_next").alias("end_ms"), *held)


def subtract(spans: DataFrame, cover: DataFrame, keys: list[str], least_ms: int = 0) -> DataFrame:
    """The union of spans without what cover holds; pieces of least_ms or longer."""
    steps, whole = _both_steps(spans, cover, keys)
    return coalesce(_swept(steps, whole, keys).filter("a > 0 and b = 0").select(*keys, "start_ms", "end_ms"), keys, least_ms, whole).drop("n")


def coverage(spans: DataFrame, cover: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's union of spans, the share that cover holds, to 4 places; a key without length has 1.0."""
    length = F.col("end_ms") - F.col("start_ms")
    got = sweep(spans, cover, keys).groupBy(*keys).agg(F.sum(F.when(F.col("a") > 0, length).otherwise(0)).alias("span_ms"), F.sum(F.when((F.col("a") > 0) & (F.col("b") > 0), length).otherwise(0)).alias("covered_ms"))
    return got.withColumn("ratio", F.when(F.col("span_ms") > 0, F.round(F.col("covered_ms") / F.col("span_ms"), 4)).otherwise(1.0))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], more_than_ms: int = 0, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of a left and a right row that share over more_than_ms; right's times become other_start_ms and other_end_ms.

    An equi-join on key and time bucket: a pair is made in the bucket where its overlap begins, so once."""
    def dealt(df: DataFrame) -> DataFrame:
        at = F.sequence(_bucket("start_ms", bucket_ms), _bucket("end_ms", bucket_ms))
        return _whole(df, keys).filter("end_ms >= start_ms").withColumn("_bucket", F.explode(at))

    b = dealt(right.select(*keys, "start_ms", "end_ms")).withColumnsRenamed({"start_ms": "other_start_ms", "end_ms": "other_end_ms"})
    shared = F.least("end_ms", "other_end_ms") - F.greatest("start_ms", "other_start_ms")
    pairs = dealt(left).join(b, [*keys, "_bucket"]).filter((shared > more_than_ms) & (F.col("_bucket") == F.floor(F.greatest("start_ms", "other_start_ms") / bucket_ms)))
    return pairs.withColumn("overlap_ms", shared).drop("_bucket")


def met(rows: DataFrame, spans: DataFrame, keys: list[str], ranges: list[tuple[Column, Column]], values: Callable[[Callable[[Column], Column], Column, Column, Column], dict[str, Column]], more_than_ms: int = -1, dealt: list[str] | None = None, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """rows, no two of them equal, with aggregates over the spans that share over more_than_ms with one of a row's ranges (low, high).

    values(held, a, b, shared) names them: held(x) is x for such spans and else null, a and b are a span's start and end, shared what it
    shares with the range. A row without a range or a span is kept. Rows take their columns along, so none is joined back; a span
    counts once for each range. `dealt`: keys that the rows are dealt by for what follows."""
    columns = rows.columns
    of = [F.struct(low.cast("long").alias("low"), high.cast("long").alias("high")) for low, high in ranges]
    left = rows.withColumn("_range", F.explode(F.array(*of)) if len(of) > 1 else of[0]).select(*columns, F.col("_range.low").alias("_low"), F.col("_range.high").alias("_high"))
    left = left.withColumn("_bucket", F.explode_outer(F.when(F.col("_high") >= F.col("_low"), F.sequence(_bucket("_low", bucket_ms), _bucket("_high", bucket_ms)))))
    right = _whole(spans.select(*keys, "start_ms", "end_ms"), keys).filter("end_ms >= start_ms")
    right = right.select(*keys, F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to"), F.explode(F.sequence(_bucket("start_ms", bucket_ms), _bucket("end_ms", bucket_ms))).alias("_bucket"))
    shared = F.least("_high", "_to") - F.greatest("_low", "_from")
    hit = (shared > more_than_ms) & (F.col("_bucket") == F.floor(F.greatest("_low", "_from") / bucket_ms))
    # what does not meet is left out in the join, before pairs are dealt again
    right = right.withColumnsRenamed({k: f"_of_{k}" for k in (*keys, "_bucket")})
    same = [F.col(k) == F.col(f"_of_{k}") for k in keys]
    both = left.join(right, [*same, F.col("_bucket") == F.col("_of__bucket"), hit], "left")
    both = both.repartition(*dealt) if dealt else both
    found = values(lambda x: F.when(F.col("_from").isNotNull(), x), F.col("_from"), F.col("_to"), shared)
    return both.groupBy(*columns).agg(*(v.alias(n) for n, v in found.items()))


def meeting(left: DataFrame, right: DataFrame, keys: list[str], own: tuple[str, str], other: tuple[str, str], cell: int) -> DataFrame:
    """Pairs of a left and a right row of the keys whose spans, from a place up to before another, share a place; the columns
    of both, whose names differ but for the keys. Rows meet by cells of places; a pair is made in the cell where its overlap begins."""
    def dealt(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        at = F.sequence(F.floor(F.col(span[0]) / cell), F.floor((F.col(span[1]) - 1) / cell))
        return df.filter(F.col(span[1]) > F.col(span[0])).withColumn("_cell", F.explode(at))

    begin = F.greatest(own[0], other[0])
    pairs = dealt(left, own).join(dealt(right, other), [*keys, "_cell"])
    return pairs.filter((F.least(own[1], other[1]) > begin) & (F.col("_cell") == F.floor(begin / cell))).drop("_cell")


def contained(points: DataFrame, spans: DataFrame, keys: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Points (keys, t_ms, ...) inside one of the spans, edges included, with the earliest such span's start; a point once.

    The reach of all spans that began before decides, so nothing is paired."""
    runs = merge(spans, keys, 0, 0, bucket_ms).select(*keys, F.col("start_ms").alias("_t"), F.struct("start_ms", "end_ms").alias("_run"))
    return _latest(points, runs, keys, bucket_ms).filter(F.col("_run.end_ms") >= F.col("t_ms")).withColumn("span_start_ms", F.col("_run.start_ms")).drop("_run")


def _latest(points: DataFrame, marks: DataFrame, keys: list[str], bucket_ms: int, later: bool = False) -> DataFrame:
    """points with _run of the last mark (keys, _t, _run) at or before t_ms (later: of the first at or after it)."""
    mine = points.dropna(subset=[*keys, "t_ms"])
    columns = mine.columns
    both = mine.select(F.struct(*columns).alias("_point"), *keys, F.col("t_ms").alias("_t")).withColumn("_run", F.lit(None).cast(marks.schema["_run"].dataType))
    every = both.unionByName(marks, allowMissingColumns=True).withColumn("_side", F.col("_point").isNotNull().cast("int") * (-1 if later else 1)).withColumn("_row", F.monotonically_increasing_id())
    value = F.when(F.col("_run").isNotNull(), F.struct("_t", "_run"))
    got = over_others(every, keys, ["_t", "_side", "_row"], F.floor(F.col("_t") / bucket_ms), Over("_found", "min" if later else "max", value, later))
    return got.filter("_point is not null").select("_point.*", F.col("_found._run").alias("_run"))


def beside(points: DataFrame, marks: dict[str, DataFrame], keys: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """points (keys, t_ms, ...) with `<name>_before` and `<name>_after` for each kind of marks (keys, t_ms): the last mark at or before
    a point and the first one behind it, or null. All kinds take one pass, and nothing is paired."""
    mine = points.dropna(subset=[*keys, "t_ms"])
    every = mine.select(*keys, F.struct(*mine.columns).alias("_point"), F.col("t_ms").alias("_t"), F.lit(None).cast("string").alias("_kind"))
    for name, of in marks.items():
        own = of.dropna(subset=[*keys, "t_ms"]).select(*keys, F.col("t_ms").alias("_t"), F.lit(name).alias("_kind"))
        every = every.unionByName(own, allowMissingColumns=True)
    every = staged(every.withColumn("_side", F.col("_point").isNotNull().cast("int")).withColumn("_row", F.monotonically_increasing_id()), "marks")
    at = {n: F.when(F.col("_kind") == n, F.col("_t")) for n in marks}
    values = [v for n in marks for v in (Over(f"{n}_before", "max", at[n]), Over(f"{n}_after", "min", at[n], later=True))]
    got = over_others(every, keys, ["_t", "_side", "_row"], F.floor(F.col("_t") / bucket_ms), *values, whole=few(every, keys))
    return got.filter("_point is not null").select("_point.*", *(v.to for v in values))


def closer(before: Column, after: Column, at: Column) -> Column:
    """The nearer of two marks, the earlier of two as near; null if there is none."""
    return F.when(before.isNotNull() & (after.isNull() | (at - before <= after - at)), before).otherwise(after)


def nearest(points: DataFrame, marks: DataFrame, keys: list[str], within_ms: int, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """points with `nearest_ms`, the nearest mark's t_ms at most within_ms away (the earlier of two as near), and the
    signed `residual_ms` (point less mark); points without such a mark stay out. No pair is made: the last mark before
    and the first after each point are carried along the time order."""
    found = beside(points, {"_mark": marks}, keys, bucket_ms)
    found = found.withColumn("nearest_ms", closer(F.col("_mark_before"), F.col("_mark_after"), F.col("t_ms")))
    return found.withColumn("residual_ms", F.col("t_ms") - F.col("nearest_ms")).filter(F.abs("residual_ms") <= within_ms).drop("_mark_before", "_mark_after")


def padded_hull(spans: DataFrame, keys: list[str], pad_ms: int = 1500) -> DataFrame:
    got = _whole(spans, keys).groupBy(*keys).agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    return got.select(*keys, F.greatest(F.lit(0), F.col("s") - pad_ms).alias("start_ms"), (F.col("e") + pad_ms).alias("end_ms"))


def split_long(spans: DataFrame, keys: list[str], longest_ms: int = 30_000) -> DataFrame:
    """Intervals cut into pieces of longest_ms, the last one shorter."""
    rows = _whole(spans, keys).filter("end_ms > start_ms")
    at = F.sequence("start_ms", F.col("end_ms") - 1, F.lit(longest_ms).cast("long"))
    rows = rows.select(*keys, "end_ms", F.explode(at).alias("s"))
    return rows.select(*keys, F.col("s").alias("start_ms"), F.least("end_ms", F.col("s") + longest_ms).alias("end_ms"))


def pack_chunks(spans: DataFrame, keys: list[str], longest_ms: int = 30_000) -> DataFrame:
    """Pieces, in order of start, greedily joined into chunks while a chunk reaches over longest_ms at most.

    The fold is sequential in a key; a key is a clip, whose pieces fit in one array."""
    pieces = split_long(spans, keys, longest_ms).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))).alias("p"))

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start_ms"].alias("start_ms"), F.greatest(last["end_ms"], x["end_ms"]).alias("end_ms"))))
        return F.when((F.size(done) > 0) & (x["end_ms"] - last["start_ms"] <= longest_ms), grown).otherwise(F.concat(done, F.array(x)))

    chunks = F.aggregate("p", F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>"), step)
    return pieces.select(*keys, F.explode(chunks).alias("c")).select(*keys, "c.start_ms", "c.end_ms")


def overlapped_windows(clips: DataFrame, keys: list[str], piece_ms: int = 120_000, reach_ms: int = 8_000) -> DataFrame:
    """(keys, duration_ms) -> request windows: pieces of piece_ms, widened by reach_ms on either side within the clip."""
    rows = clips.filter("duration_ms > 0").select(*keys, "duration_ms", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("duration_ms") - 1, F.lit(piece_ms).cast("long"))).alias("window", "s"))
    return rows.select(*keys, "window", F.greatest(F.lit(0), F.col("s") - reach_ms).alias("start_ms"), F.least("duration_ms", F.col("s") + piece_ms + reach_ms).alias("end_ms"))


def request_plan(slices: DataFrame, speech: DataFrame, keys: list[str], longest_ms: int = 240_000, late: float = 0.6) -> DataFrame:
    """Slices (keys, start_ms, end_ms), in order of start, joined into requests of longest_ms at most: (keys, start_ms, end_ms).

    A slice that is longer itself is cut at the last end of speech in the last part of the time that a request has (from
    `late` of it on), else where that time is over; what is left of it is joined on. Where a request ends hangs on those before,
    so one clip's slices and ends of speech are folded as arrays; a clip is one recording."""
    own = _whole(slices, keys).filter("end_ms > start_ms").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))).alias("p"))
    ends = _whole(speech, keys).groupBy(*keys).agg(F.array_sort(F.collect_set("end_ms")).alias("_ends"))
    rows = own.join(ends, keys, "left").withColumn("_ends", F.coalesce("_ends", F.array().cast("array<bigint>")))
    span = lambda s, e: F.struct(s.alias("start_ms"), e.alias("end_ms"))

    def cut(plan: Column) -> Column:
        """The last request of the plan, if too long, in two."""
        last = F.element_at(plan, -1)
        s, e = last["start_ms"], last["end_ms"]
        at = F.coalesce(F.array_max(F.filter("_ends", lambda t: (t >= s + F.lit(late) * longest_ms) & (t <= s + longest_ms))), s + longest_ms)
        return F.when(e - s > longest_ms, F.concat(F.slice(plan, F.lit(1), F.size(plan) - 1), F.array(span(s, at), span(at, e)))).otherwise(plan)

    def step(plan: Column, x: Column) -> Column:
        last = F.try_element_at(plan, F.lit(-1))
        joins = (F.size(plan) > 0) & (x["end_ms"] - last["start_ms"] <= longest_ms)
        grown = F.when(joins, F.concat(F.slice(plan, F.lit(1), F.size(plan) - 1), F.array(span(last["start_ms"], x["end_ms"])))).otherwise(F.concat(plan, F.array(span(x["start_ms"], x["end_ms"]))))
        times = F.ceil((x["end_ms"] - x["start_ms"]) / (late * longest_ms)).cast("int")
        return F.aggregate(F.sequence(F.lit(0), times), grown, lambda done, _: cut(done))

    plan = F.aggregate("p", F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>"), step)
    return rows.select(*keys, F.explode(plan).alias("r")).select(*keys, "r.start_ms", "r.end_ms")


def halved(spans: DataFrame, keys: list[str], failed: Column, least_ms: int, depth: int = 3) -> DataFrame:
    """(keys, start_ms, end_ms, ...) -> the same with `depth` and `failed`: spans for which `failed` is true are halved and
    tried again, each half for itself, unless they are shorter than least_ms or were halved `depth` times already.

    `failed` is an expression over the rows, such as an answer's status; halves keep the other columns. The middle is
    rounded down to a millisecond. Each round halves only what failed in the one before; what still fails at the end has
    failed = true, and null counts as false."""
    now, done = _whole(spans, keys).withColumn("depth", F.lit(0)), None
    middle = F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) / 2)
    for level in range(depth + 1):
        tried = now.withColumn("failed", F.coalesce(failed, F.lit(False)))
        again = F.col("failed") & (F.col("end_ms") - F.col("start_ms") >= least_ms) & F.lit(level < depth)
        kept = tried.filter(~again)
        done = kept if done is None else done.unionByName(kept)
        halves = F.explode(F.array(F.struct(F.col("start_ms").alias("s"), middle.alias("e")), F.struct(middle.alias("s"), F.col("end_ms").alias("e"))))
        now = tried.filter(again).drop("failed").withColumn("_half", halves).withColumns({"start_ms": F.col("_half.s"), "end_ms": F.col("_half.e"), "depth": F.col("depth") + 1}).drop("_half")
    return done
