"""Stateful streams: offset-addressed uploads, starts of jobs once per key, sessions; and their batch forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import Over, over_others

UPLOADS = "media_id string, stored long, accepted long, rejected long, complete boolean"


def apply_slices(stored: int, slices: list[tuple[int, int, int]], most: int, strict: bool = True) -> tuple[int, int, int, bool]:
    """Slices (offset, size, total) in order of arrival onto `stored` bytes: offset 0 starts anew, any offset but the
    stored size is rejected, as is what would pass `most` bytes. Without `strict` a slice goes wherever it says."""
    accepted = rejected = 0
    complete = False
    for offset, size, total in slices:
        base = 0 if offset == 0 else stored
        if (strict and offset != base) or offset + size > most:
            rejected += 1
            continue
        stored, accepted = offset + size if strict or offset == 0 else max(stored, offset + size), accepted + 1
        complete = stored >= total > 0
    return stored, accepted, rejected, complete


def uploads(slices: DataFrame, most: int = 512 << 20, idle_ms: int | None = None, strict: bool = True) -> DataFrame:
    """A stream of (media_id, seq, offset, size, total) -> the state of each upload, a row for each batch that touches it.

    Slices of one batch are applied in order of seq; what does not fit is rejected, never held back. With
    idle_ms, the state of an upload that is idle so long goes; such a stream never ends by itself, as timers need batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored, accepted, rejected, complete = state.get if state.exists else (0, 0, 0, False)
        rows = sorted(t for f in frames for t in zip(f["seq"], f["offset"], f["size"], f["total"], strict=True))
        stored, a, r, done = apply_slices(int(stored), [tuple(map(int, t[1:])) for t in rows], most, strict)
        accepted, rejected = accepted + a, rejected + r
        complete = done if a else complete
        state.update((stored, accepted, rejected, complete))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], stored, accepted, rejected, complete)], columns=["media_id", "stored", "accepted", "rejected", "complete"])

    return slices.groupBy("media_id").applyInPandasWithState(step, UPLOADS, "stored long, accepted long, rejected long, complete boolean", "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def latest_status(updates: DataFrame) -> DataFrame:
    """Updates (media_id, batch, ...) of uploads, as a table sink keeps them -> the last of each."""
    columns = [c for c in updates.columns if c != "media_id"]
    return updates.groupBy("media_id").agg(F.max_by(F.struct(*columns), "batch").alias("x")).select("media_id", "x.*")


def first_starts(starts: DataFrame, key: str, at: str, within: str) -> DataFrame:
    """A stream of job starts -> one row per key while the watermark still covers it."""
    return starts.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """A stream of events -> sessions of each key, given out once the watermark has passed them."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n_events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def evictions(files: DataFrame, cap: int) -> DataFrame:
    """Batch form of the cache's eviction: (path, mtime, size, eligible) -> the files that go, oldest first, until the
    total is at most `cap`; only eligible ones can go: a file goes iff what is left without the older ones is too much."""
    total = files.groupBy(F.lit(1).alias("_all")).agg(F.sum("size").alias("_total"))
    rows = files.filter("eligible").withColumn("_all", F.lit(1))
    rows = over_others(rows, ["_all"], ["mtime", "path"], F.floor(F.col("mtime") / 86_400_000), Over("_older", "sum", F.col("size")))
    return rows.join(total, "_all").filter(F.col("_total") - F.coalesce("_older", F.lit(0)) > cap).select("path", "mtime", "size")


def purged(starts: DataFrame, key: str, job: str, at: str, ttl_ms: int, late: str) -> DataFrame:
    """A stream of job starts (key, job, at: a timestamp) -> (key, job, created_ms, orphan): each job once the watermark is over
    ttl_ms past its start, and whether its key has no job then, so that the key goes too.

    State is a key's living jobs; a timer on event time wakes it at the end of the oldest one, so an idle key is freed as
    well. Starts later than the watermark are dropped, as are null keys, jobs and times."""
    kinds = dict(starts.dtypes)

    def step(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        created, jobs = state.get if state.exists else ([], [])
        living = list(zip(created, jobs, strict=True))
        if not state.hasTimedOut:
            living += [t for f in frames for t in zip(f["_ms"].tolist(), f[job].tolist(), strict=True)]
        living.sort()
        now = state.getCurrentWatermarkMs()
        gone = [k for k, (ms, _) in enumerate(living) if ms + ttl_ms < now]
        if gone:
            left = [k + 1 == len(living) or living[k + 1][0] > living[k][0] + ttl_ms for k in gone]
            yield pd.DataFrame({key: [own[0]] * len(gone), job: [living[k][1] for k in gone], "created_ms": [living[k][0] for k in gone], "orphan": left})
        living = living[len(gone) :]
        if living:
            state.update(([ms for ms, _ in living], [j for _, j in living]))
            state.setTimeoutTimestamp(max(now + 1, living[0][0] + ttl_ms))
        elif state.exists:
            state.remove()

    rows = starts.dropna(subset=[key, job, at]).withWatermark(at, late).select(key, job, at, F.unix_millis(at).alias("_ms"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {job} {kinds[job]}, created_ms long, orphan boolean", f"created array<long>, jobs array<{kinds[job]}>", "append", GroupStateTimeout.EventTimeTimeout)


def expired(jobs: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """Jobs (key, start_ms) older than ttl_ms."""
    return jobs.filter(F.lit(now_ms) - F.col("start_ms") > ttl_ms)


def first_in_batch(starts: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The batch form of first_starts: the first row of each key."""
    columns = [c for c in starts.columns if c not in key]
    return starts.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("x")).select(*key, "x.*")


def progress(events: DataFrame, key: str, order: str, stages: dict[str, int]) -> DataFrame:
    """The highest percentage so far of each stream of stage names."""
    table = F.create_map(*(F.lit(x) for kv in stages.items() for x in kv))
    over = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("percent", F.max(F.try_element_at(table, F.col("stage"))).over(over))
