"""Edges of phrases set against measured speech: (clip_id, phrase_id, start_ms, end_ms), times in integer milliseconds.

phrase_id is distinct. A phrase is compared with the spans near its edges alone, by range joins on time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals

KEY = ["clip_id"]
# Fixed values, in milliseconds.
INSIDE, BESIDE = 1500, 600
HOLD_MID, HOLD_FINAL, EARLIER = 1800, 3500, 30
ON_ONSET, LATE, EARLY = 100, 350, 500


def _near(phrases: DataFrame, spans: DataFrame, edge: str, at: Column, low: Column, high: Column) -> DataFrame:
    """(phrase_id, edge, at_ms, other_start_ms, other_end_ms) of the spans that touch low..high."""
    own = phrases.select("phrase_id", "clip_id", F.lit(edge).alias("edge"), at.alias("at_ms"), low.alias("start_ms"), high.alias("end_ms"))
    return intervals.overlaps(own, spans, KEY, -1)


def clamp(phrases: DataFrame, speech: DataFrame) -> DataFrame:
    """phrases with start_ms and end_ms moved to edges of speech; first_start_ms, first_end_ms, last_start_ms and
    last_end_ms are the times of a phrase's first and last word.

    A word's edge inside a span moves to the span's own edge, if that is INSIDE or less away from the phrase's edge;
    an edge in silence to the outermost edge of the spans that the word, widened by BESIDE, touches, if that is BESIDE
    or less away. Phrases of clips without speech, or with a null time, stay as they are."""
    spans = speech.select("clip_id", "start_ms", "end_ms")
    first, last = F.col("first_start_ms"), F.col("last_end_ms")
    near = _near(phrases, spans, "s", first, first - BESIDE, F.greatest(first, "first_end_ms"))
    near = near.unionByName(_near(phrases, spans, "e", last, F.least(last, "last_start_ms"), last + BESIDE))
    inside, starts, ends = F.col("at_ms").between(F.col("other_start_ms"), F.col("other_end_ms")), F.col("edge") == "s", F.col("edge") == "e"
    best = near.groupBy("phrase_id").agg(
        F.min(F.when(starts & inside, F.col("other_start_ms"))).alias("_s_in"),
        F.min(F.when(starts, F.col("other_start_ms"))).alias("_s_by"),
        F.max(F.when(ends & inside, F.col("other_end_ms"))).alias("_e_in"),
        F.max(F.when(ends, F.col("other_end_ms"))).alias("_e_by"),
    )

    def moved(edge: str, within: str, beside: str) -> Column:
        to = F.coalesce(within, beside)
        reach = F.when(F.col(within).isNotNull(), INSIDE).otherwise(BESIDE)
        return F.when(F.abs(to - F.col(edge)) <= reach, to).otherwise(F.col(edge))

    rows = phrases.join(best, "phrase_id", "left")
    return rows.withColumns({"start_ms": moved("start_ms", "_s_in", "_s_by"), "end_ms": moved("end_ms", "_e_in", "_e_by")}).drop("_s_in", "_s_by", "_e_in", "_e_by")


def hold_tails(phrases: DataFrame, speech: DataFrame, silence: DataFrame) -> DataFrame:
    """phrases with end_ms held over a long last vowel: `held` tells whether there is one, `final` whether the phrase
    ends its verse, `cap_ms` (or null) where the next phrase stops it.

    The end moves by HOLD_MID (final: HOLD_FINAL) at most, within the span of speech that covers it, and not past the
    first silence that begins more than EARLIER before it. Without a covering span it stays, and it never moves back."""
    end = F.col("end_ms")
    long = phrases.filter("held")
    covers = _near(long, speech.select("clip_id", "start_ms", "end_ms"), "c", end, end, end).groupBy("phrase_id").agg(F.max("other_end_ms").alias("_cover"))
    marks = silence.select("clip_id", "start_ms", F.col("start_ms").alias("end_ms"))
    stops = _near(long, marks, "q", end, end - EARLIER + 1, end + HOLD_FINAL).groupBy("phrase_id").agg(F.min("other_start_ms").alias("_stop"))
    rows = phrases.join(covers, "phrase_id", "left").join(stops, "phrase_id", "left")
    limit = F.least(end + F.when(F.col("final"), HOLD_FINAL).otherwise(HOLD_MID), "_cover", "cap_ms", "_stop")
    return rows.withColumn("end_ms", F.when(F.col("_cover").isNull(), end).otherwise(F.greatest(end, limit))).drop("_cover", "_stop")


def onset_issues(cues: DataFrame, speech: DataFrame, words: DataFrame, within_ms: int = INSIDE) -> DataFrame:
    """(clip_id, phrase_id, kind, severity, t0_ms, t1_ms) of cues that start over LATE after, or over EARLY before, the
    nearest word's start; a cue within ON_ONSET of an onset of speech has no issue, nor one without a word in within_ms."""
    at = lambda df, *more: df.select("clip_id", *more, F.col("start_ms").alias("t_ms"))
    near = intervals.beside(at(cues, "phrase_id"), {"_onset": at(speech), "_word": at(words)}, KEY)
    found = lambda kind: F.col("t_ms") - intervals.closer(F.col(f"{kind}_before"), F.col(f"{kind}_after"), F.col("t_ms"))
    rest = near.filter(F.coalesce(F.abs(found("_onset")) > ON_ONSET, F.lit(True)))
    off = rest.withColumn("residual_ms", found("_word")).filter(F.abs("residual_ms") <= within_ms)
    kind = F.when(F.col("residual_ms") > LATE, "late_start").when(F.col("residual_ms") < -EARLY, "early_start")
    return off.withColumn("kind", kind).filter("kind is not null").select("clip_id", "phrase_id", "kind", F.lit("info").alias("severity"), F.col("t_ms").alias("t0_ms"), (F.col("t_ms") + F.abs("residual_ms")).alias("t1_ms"))
