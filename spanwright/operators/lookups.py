"""Lookups, gates and memberships: small joins and filters over transcripts, words, requests and job logs.

Times are integer milliseconds. Rows with a null key meet nothing; left lookups keep them with the default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged
from . import intervals
from .ordered import Over, over_others

HOUR = 3_600_000


def with_default(rows: DataFrame, table: DataFrame, keys: list[str], value: str, default: str = "") -> DataFrame:
    """rows with `value` of the table's row of the same keys (distinct there), or the default."""
    found = table.select(*keys, value).dropna(subset=keys)
    return rows.join(found, keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def verses(canon: DataFrame, chapter: int, first: int = 1, last: int | None = None) -> DataFrame:
    """The verses first..last (or to the end) of a chapter that there are."""
    rows = canon.filter((F.col("chapter") == chapter) & (F.col("verse") >= first))
    return rows if last is None else rows.filter(F.col("verse") <= last)


def text_index(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(text, key) of each distinct text: of rows with equal texts the highest key."""
    return rows.groupBy(text.alias("text")).agg(F.max(key).alias(key))


def stored_copies(known: DataFrame, disk: DataFrame, key: str) -> DataFrame:
    """(key, size, total, source): the copy in memory, else the one on disk; a copy smaller than its declared total is
    not there, one without a total is trusted."""
    whole = F.coalesce(F.col("size") >= F.col("total"), F.lit(True))
    a = known.filter(whole).select(key, F.struct("size", "total", F.lit("memory").alias("source")).alias("a"))
    b = disk.filter(whole).select(key, F.struct("size", "total", F.lit("disk").alias("source")).alias("b"))
    return a.join(b, key, "full").select(key, F.coalesce("a", "b").alias("x")).select(key, "x.*")


def validated(results: DataFrame, words: DataFrame, key: str, least_words: int = 10, least_share: float = 0.35) -> DataFrame:
    """results (key, kind, voiced_ms) with `status`: too_few_words, too_little_aligned, nothing_recited or ok; words (key, start_ms, end_ms)."""
    own = words.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("aligned"))
    kinds = results.groupBy(key).agg(F.max("voiced_ms").alias("voiced"), F.count_if(F.col("kind") == "recited").alias("recited"))
    rows = kinds.join(own, key, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "aligned": F.coalesce("aligned", F.lit(0))})
    status = F.when(F.col("n") < least_words, "too_few_words").when(F.col("aligned") < least_share * F.col("voiced"), "too_little_aligned").when(F.col("recited") == 0, "nothing_recited").otherwise("ok")
    return rows.select(key, F.col("n").cast("long").alias("n_words"), status.alias("status"))


def long_enough(spans: DataFrame, chunk_ms: int = 200, clip_ms: int = 500) -> DataFrame:
    """Spans of chunk_ms or more in clips whose spans reach over clip_ms or more."""
    clips = spans.groupBy("clip_id").agg((F.max("end_ms") - F.min("start_ms")).alias("_reach")).filter(F.col("_reach") >= clip_ms).select("clip_id")
    return spans.filter(F.col("end_ms") - F.col("start_ms") >= chunk_ms).join(clips, "clip_id", "left_semi")


def loud_windows(levels: DataFrame, least: float = 0.005, share: float = 0.15) -> DataFrame:
    """(clip_id, window, rms) of the windows that are no quieter than `least` and than `share` of the clip's loudest."""
    top = levels.groupBy("clip_id").agg(F.max("rms").alias("_top"))
    return levels.join(top, "clip_id").filter(F.col("rms") >= F.greatest(F.lit(least), share * F.col("_top"))).drop("_top")


def inside_by_middle(words: DataFrame, cues: DataFrame, slack_ms: int = 20) -> DataFrame:
    """words whose middle lies in a cue widened by slack_ms, edges included, with the cue's times; a word once for each such cue."""
    middle = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    points = words.withColumn("_a", F.col("start_ms")).withColumn("_b", F.col("end_ms")).withColumn("start_ms", middle).withColumn("end_ms", middle)
    wide = cues.select("clip_id", (F.col("start_ms") - slack_ms).alias("start_ms"), (F.col("end_ms") + slack_ms).alias("end_ms"))
    pairs = intervals.overlaps(points, wide, ["clip_id"], -1)
    exact = (2 * F.col("other_start_ms") <= F.col("_a") + F.col("_b")) & (F.col("_a") + F.col("_b") <= 2 * F.col("other_end_ms"))
    pairs = pairs.filter(exact).withColumns({"start_ms": F.col("_a"), "end_ms": F.col("_b"), "cue_start_ms": F.col("other_start_ms") + slack_ms, "cue_end_ms": F.col("other_end_ms") - slack_ms})
    return pairs.drop("_a", "_b", "other_start_ms", "other_end_ms", "overlap_ms")


def chunk_of_word(chunks: DataFrame, words: DataFrame, key: str, order: str, count: str, place: str) -> DataFrame:
    """words (key, place) with the `order` of the chunk that holds the place, by running word counts of the chunks.

    A chunk's places are few, so they are listed and the join is one on equal keys."""
    rows = over_others(chunks.select(key, order, count), [key], [order], F.floor(F.col(order) / 65_536), Over("_before", "sum", F.col(count)))
    first = F.coalesce("_before", F.lit(0))
    listed = rows.filter(F.col(count) > 0).select(key, order, F.explode(F.sequence(first, first + F.col(count) - 1)).alias(place))
    return words.join(listed, [key, place])


def without_overlap(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """words (clip_id, chunk, start_ms, ...) that don't begin before the end of the chunk before theirs; chunks (clip_id, chunk, end_ms)."""
    bound = chunks.select("clip_id", (F.col("chunk") + 1).alias("chunk"), F.col("end_ms").alias("_bound"))
    return words.join(bound, ["clip_id", "chunk"], "left").filter(F.coalesce(F.col("start_ms") >= F.col("_bound"), F.lit(True))).drop("_bound")


def final_hold(cues: DataFrame, ends: DataFrame) -> DataFrame:
    """cues, the last one of a clip ending at the later of speech_end_ms and audible_end_ms, and no later than duration_ms
    (of ends, one row a clip); cues end as they do where that is earlier."""
    last = cues.groupBy("clip_id").agg(F.max(F.struct("start_ms", "end_ms")).alias("_last"))
    rows = cues.join(last, "clip_id").join(ends, "clip_id", "left")
    until = F.least(F.greatest("speech_end_ms", "audible_end_ms"), "duration_ms")
    is_last = (F.col("start_ms") == F.col("_last.start_ms")) & (F.col("end_ms") == F.col("_last.end_ms"))
    return rows.select(*(F.when(is_last, F.greatest("end_ms", until)).otherwise(F.col("end_ms")).alias("end_ms") if c == "end_ms" else F.col(c) for c in cues.columns))


def most_common(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the most frequent value of each key, the lowest of equally frequent ones; nulls don't count."""
    counts = rows.dropna(subset=[value]).groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("v"))).alias("x"))
    return best.select(key, F.col("x.v").alias(value), (-F.col("x.less")).alias("n"))


def signature(cues: DataFrame) -> DataFrame:
    """(clip_id, n, start_sum_ms, end_sum_ms): what tells whether a clip's cues have changed."""
    return cues.groupBy("clip_id").agg(F.count("*").alias("n"), F.sum("start_ms").alias("start_sum_ms"), F.sum("end_ms").alias("end_sum_ms"))


def result_card(matches: DataFrame, cues: DataFrame) -> DataFrame:
    """(clip_id, passages, n_cues, score): inclusive count of the matched passages (first, last), never under 0."""
    n = cues.groupBy("clip_id").agg(F.count("*").alias("n_cues"))
    rows = matches.select("clip_id", F.greatest(F.lit(0).cast("long"), F.col("last") - F.col("first") + 1).alias("passages"), "score")
    return rows.join(n, "clip_id", "left").withColumn("n_cues", F.coalesce("n_cues", F.lit(0)))


def shown_at(points: DataFrame, cues: DataFrame, bucket_ms: int = intervals.BUCKET_MS) -> DataFrame:
    """points (clip_id, t_ms, ...) with the first cue (by start, then end) that shows at t_ms: from its start, before its end."""
    spots = points.withColumn("start_ms", F.col("t_ms")).withColumn("end_ms", F.col("t_ms"))
    pairs = intervals.overlaps(spots, cues.filter("end_ms > start_ms"), ["clip_id"], -1, bucket_ms).filter(F.col("t_ms") < F.col("other_end_ms"))
    best = pairs.groupBy(*points.columns).agg(F.min(F.struct("other_start_ms", "other_end_ms")).alias("c"))
    return best.select(*points.columns, F.col("c.other_start_ms").alias("cue_start_ms"), F.col("c.other_end_ms").alias("cue_end_ms"))


def neighbour_padded(spans: DataFrame, pad_ms: int = 30) -> DataFrame:
    """Disjoint spans widened by pad_ms on either side; neighbours nearer than twice that share what is between them, the
    earlier one taking the smaller half; starts are no earlier than 0."""
    rows = over_others(
        spans.select("clip_id", "start_ms", "end_ms"), ["clip_id"], ["start_ms", "end_ms"], F.floor(F.col("start_ms") / intervals.BUCKET_MS),
        Over("_before", "max", F.struct("start_ms", "end_ms")), Over("_next", "min", F.struct("start_ms", "end_ms"), later=True),
    )
    half = lambda gap: F.when(gap < 2 * pad_ms, F.floor(gap / 2)).otherwise(pad_ms)
    ahead, behind = F.col("start_ms") - F.col("_before.end_ms"), F.col("_next.start_ms") - F.col("end_ms")
    start = F.when(F.col("_before").isNull(), F.greatest(F.lit(0), F.col("start_ms") - pad_ms)).otherwise(F.col("start_ms") - half(ahead))
    return rows.select("clip_id", start.alias("start_ms"), (F.col("end_ms") + F.when(F.col("_next").isNull(), pad_ms).otherwise(half(behind))).alias("end_ms"))


def missed_streaks(polls: DataFrame, key: str, order: str, missed: Column, most: int = 5) -> DataFrame:
    """(key, given_up): the place of the poll with which `most` in a row were missed first, if any; a success starts anew."""
    rows = over_others(polls.withColumn("_missed", missed), [key], [order], F.floor(F.col(order) / 65_536), Over("_n", "sum", F.lit(1)), Over("_good", "max", F.when(~missed, F.col(order))))
    rows = staged(rows.withColumn("_n", F.coalesce("_n", F.lit(0)) + 1), "polls")
    good = rows.filter(~F.col("_missed")).select(key, F.col(order).alias("_good"), F.col("_n").alias("_at"))
    streak = F.col("_n") - F.coalesce("_at", F.lit(0))
    found = rows.filter("_missed").join(good, [key, "_good"], "left").filter(streak >= most)
    return found.groupBy(key).agg(F.min(order).alias("given_up"))


def waits(errors: DataFrame, base_ms: int = 3000, longest_ms: int = 10_000) -> DataFrame:
    """errors (attempt, retry_after_ms) with `wait_ms`: what the server asks for, longest_ms at most, else base_ms doubled with each attempt."""
    asked = F.when(F.col("retry_after_ms").isNotNull(), F.least(F.col("retry_after_ms"), F.lit(longest_ms).cast("long")))
    return errors.withColumn("wait_ms", F.coalesce(asked, F.lit(base_ms).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.col("attempt"), F.lit(20)).cast("int"))))


def overlap_share(rows: DataFrame, hole: str, form: str) -> DataFrame:
    """rows with `share` of the words of array `hole`, repeats counted, that array `form` has; 0 for an empty hole."""
    own = F.size(F.filter(hole, lambda x: F.array_contains(form, x)))
    return rows.withColumn("share", F.when(F.size(hole) > 0, F.round(own / F.size(hole), 6)).otherwise(0.0))


def subsequences(rows: DataFrame, key: str, text: str, wanted: list[str]) -> DataFrame:
    """(key, place): where the wanted words stand in a row first, from 0; rows without them stay out."""
    n = len(wanted)
    at = F.sequence(F.lit(0), F.size(text) - n)
    hits = F.filter(at, lambda i: F.slice(text, i + 1, F.lit(n)) == F.array(*map(F.lit, wanted)))
    return rows.filter(F.size(text) >= n).select(key, F.array_min(hits).alias("place")).filter("place is not null")
