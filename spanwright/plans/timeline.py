"""Queries on `events` as clips: a user is a clip, an event an interval from its time on, as long as its value in units of 6 s."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import millis
from ..operators import cues, edges, intervals, runs, signal
from ..operators.ordered import Over, over_others
from ..sources import subtitles
from ..sources.shared import new_path, table
from ..streaming import state

KEY = ["clip_id"]
DAY = 86_400_000
MINUTE = 60_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = millis(F.col("ts"))
    df = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("clip_id"), "event_type", "value", t.alias("start_ms"))
    return df.withColumn("end_ms", F.col("start_ms") + F.round(F.col("value") * 6000).cast("long")).withColumn("t_ms", F.col("start_ms"))


def of(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    return events(spark, sf_dir).filter(F.col("event_type").isin(*kinds))


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(spark, sf_dir, "view", "click")


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(spark, sf_dir, "purchase", "signup").withColumn("text", F.concat("event_type", F.lit(", "), F.col("event_id").cast("string")))


def cue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions(spark, sf_dir).select("clip_id", "start_ms", "end_ms", "text")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("clip_id").orderBy("t_ms", "event_id")
    return events(spark, sf_dir).select("clip_id", (F.row_number().over(order) - 1).cast("long").alias("i"), (F.col("value") / 500).alias("x"))


def silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gaps(speech(spark, sf_dir), KEY, 250)


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = of(spark, sf_dir, "purchase").select("event_id", "clip_id", "t_ms")
    return intervals.nearest(points, of(spark, sf_dir, "view").select("clip_id", "t_ms"), KEY, 600 * MINUTE)


def residual_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signal.residual_stats(residuals(spark, sf_dir), KEY, "residual_ms")
    return found.select("clip_id", "n", F.round("mean", 3).alias("mean"), F.round("deviation", 3).alias("deviation"))


def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = events(spark, sf_dir).select("clip_id", "t_ms", (F.col("value") / 500).alias("p"))
    return runs.hysteresis(frames, KEY, 0.2, 0.1, 60 * MINUTE, 10 * MINUTE, F.floor(F.col("t_ms") / DAY))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = events(spark, sf_dir).groupBy("clip_id").agg((F.sum("end_ms") - F.sum("start_ms")).alias("duration_ms"))
    return intervals.overlapped_windows(clips, KEY, 20 * MINUTE, MINUTE)


def evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = of(spark, sf_dir, "purchase", "error").select(F.col("event_id").alias("path"), F.col("t_ms").alias("mtime"), (F.col("end_ms") - F.col("start_ms")).alias("size"), (F.col("event_type") == "purchase").alias("eligible"))
    return state.evictions(files, 500_000_000)


def first_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("clip_id", "event_type", "event_id", "t_ms")
    return state.first_in_batch(rows, ["clip_id", "event_type"], ["t_ms", "event_id"])


def expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = first_starts(spark, sf_dir).select("clip_id", "event_type", F.col("t_ms").alias("start_ms"))
    return state.expired(jobs, 1704067200000 + 30 * 60 * MINUTE, 24 * 60 * MINUTE)


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays `events` as a stream into a table in the shared folder; what is still open at the end of the watermark is
    worked out from each user's events behind the last session that the stream gave out."""
    # a pattern, as a stream's path that is no pattern has to be a folder
    path = f"{sf_dir}/events.parque[t]"
    events_ = table(spark, sf_dir, "events")
    columns = ["user_id", F.col("ts").cast("timestamp").alias("at")]
    stream = spark.readStream.schema(events_.schema).parquet(path).select(*columns)
    to, log = new_path(spark, "sessions"), new_path(spark, "sessions-log")
    query = state.sessions(stream, "user_id", "at", "30 minutes", "1 hour").writeStream.format("parquet").option("path", to).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.schema("user_id long, start timestamp, end timestamp, n_events long").parquet(to)
    last = done.groupBy("user_id").agg(F.max("end").alias("last"))
    rest = events_.select(*columns).dropna().join(last, "user_id", "left").filter("last is null or at > last")
    every = done.unionByName(state.sessions(rest, "user_id", "at", "30 minutes", "1 hour"))
    ms = lambda c: millis(F.col(c).cast("timestamp_ntz")).alias(f"{c}_ms")
    return every.select("user_id", ms("start"), ms("end"), "n_events")


def purged_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as starts of jobs, replayed as a stream: those that a day's life has ended for by the stream's last watermark."""
    events_ = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events_.schema).parquet(f"{sf_dir}/events.parque[t]").filter("event_type = 'signup'")
    starts = stream.select("user_id", "event_id", F.timestamp_millis(millis(F.col("ts"))).alias("at"))
    to, log = new_path(spark, "purged"), new_path(spark, "purged-log")
    purges = state.purged(starts, "user_id", "event_id", "at", 24 * 60 * MINUTE, "1 hour")
    purges.writeStream.format("parquet").option("path", to).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(purges.schema).parquet(to)


def words_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("clip_id").orderBy("t_ms", "event_id")
    return captions(spark, sf_dir).select("clip_id", (F.row_number().over(order) - 1).cast("long").alias("idx"), "start_ms", "end_ms")


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions as phrases of one word."""
    return captions(spark, sf_dir).select("clip_id", F.col("event_id").alias("phrase_id"), "start_ms", "end_ms", "event_type")


def clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = [F.col(x).alias(f"{w}_{x}") for w in ("first", "last") for x in ("start_ms", "end_ms")]
    rows = phrases(spark, sf_dir).select("*", *word)
    return edges.clamp(rows, intervals.coalesce(speech(spark, sf_dir), KEY)).select("clip_id", "phrase_id", "start_ms", "end_ms")


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = over_others(phrases(spark, sf_dir), KEY, ["start_ms", "phrase_id"], F.floor(F.col("start_ms") / DAY), Over("_next", "min", F.col("start_ms"), later=True))
    rows = rows.select("*", (F.col("phrase_id") % 2 == 0).alias("held"), (F.col("event_type") == "signup").alias("final"), (F.col("_next") - cues.LEAST_GAP).alias("cap_ms"))
    spans = intervals.coalesce(speech(spark, sf_dir), KEY)
    return edges.hold_tails(rows, spans, of(spark, sf_dir, "error")).select("clip_id", "phrase_id", "start_ms", "end_ms")


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.onset_issues(phrases(spark, sf_dir), intervals.merge(speech(spark, sf_dir), KEY), of(spark, sf_dir, "error"), 100 * DAY)


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as words of a transcript: their places in a canon rise and step back."""
    order = Window.partitionBy("clip_id").orderBy("t_ms", "event_id")
    rows = events(spark, sf_dir).select("clip_id", (F.row_number().over(order) - 1).cast("long").alias("idx"), "start_ms", F.least("end_ms", F.col("start_ms") + 60_000).alias("end_ms"), "event_id")
    return rows.withColumn("place", F.when(F.col("event_id") % 13 != 0, F.col("idx") - F.col("event_id") % 3))


def cue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cues.phrases(placed(spark, sf_dir), silence(spark, sf_dir))
    return cues.grouped(rows, 30 * MINUTE).select("clip_id", "phrase", "idx", F.col("cue").cast("long").alias("cue"))


def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.energy_segments(samples(spark, sf_dir).select("clip_id", F.col("i").alias("hop"), F.col("x").alias("rms")), KEY, on_share=0.3, off_share=0.25)


QUERIES = {
    "session_islands": lambda s, d: intervals.merge(events(s, d).withColumn("end_ms", F.col("start_ms")), KEY, 30 * MINUTE),
    "speech_merged": lambda s, d: intervals.merge(speech(s, d), KEY, 2000),
    "speech_union": lambda s, d: intervals.coalesce(speech(s, d), KEY, 60_000),
    "silence_gaps": silence,
    "union_length": lambda s, d: intervals.union_length(speech(s, d), KEY),
    "uncovered_speech": lambda s, d: intervals.subtract(speech(s, d), captions(s, d), KEY, 300),
    "coverage_ratio": lambda s, d: intervals.coverage(speech(s, d), captions(s, d), KEY),
    "caption_over_silence": lambda s, d: intervals.overlaps(captions(s, d).select("event_id", "clip_id", "start_ms", "end_ms"), silence(s, d), KEY, 150),
    "points_in_speech": lambda s, d: intervals.contained(of(s, d, "error").select("event_id", "clip_id", "t_ms"), speech(s, d), KEY),
    "nearest_residuals": residuals,
    "residual_stats": residual_stats,
    "padded_hull": lambda s, d: intervals.padded_hull(speech(s, d), KEY),
    "split_pieces": lambda s, d: intervals.split_long(speech(s, d), KEY, 10 * MINUTE),
    "packed_chunks": lambda s, d: intervals.pack_chunks(intervals.coalesce(speech(s, d), KEY), KEY, 60 * MINUTE),
    "overlapped_windows": windows,
    "rms_per_hop": lambda s, d: signal.rms_per_hop(samples(s, d), KEY, 7).withColumn("rms", F.round("rms", 6)),
    "bucket_max_carried": lambda s, d: signal.bucket_max_carried(samples(s, d).withColumn("x", F.when(F.col("x") > 0.1, F.col("x")).otherwise(0.0)), KEY, 3),
    "max_pooled": lambda s, d: signal.max_pool(samples(s, d), KEY, 20),
    "quantized_envelope": lambda s, d: signal.quantized(signal.max_pool(samples(s, d), KEY, 20), KEY),
    "audible_end": lambda s, d: signal.audible_end(samples(s, d), KEY, 0.5),
    "hysteresis_segments": hysteresis,
    "energy_segments": energy,
    "clamped_phrases": clamped,
    "held_tails": held,
    "onset_issues": onsets,
    "repaired_cues": lambda s, d: cues.repair_edits(cue_rows(s, d)),
    "trimmed_cues": lambda s, d: cues.trim_overhang(cue_rows(s, d), silence(s, d)),
    "closed_cue_gaps": lambda s, d: cues.close_gaps(cue_rows(s, d), silence(s, d)),
    "corrected_words": lambda s, d: cues.corrected_words(words_of(s, d), intervals.coalesce(speech(s, d), KEY)),
    "silence_between_words": lambda s, d: cues.silence_between(words_of(s, d), silence(s, d)),
    "pause_phrases": lambda s, d: cues.phrases(words_of(s, d), silence(s, d)),
    "stamp_phrases": lambda s, d: cues.phrases(words_of(s, d), None),
    "cue_groups": cue_groups,
    "snapped_words": lambda s, d: cues.snap_words(words_of(s, d), silence(s, d)),
    "shown_cues": lambda s, d: cues.show(cue_rows(s, d), silence(s, d)),
    "audit_issues": lambda s, d: cues.audit(cue_rows(s, d), speech(s, d)),
    "audit_counts": lambda s, d: cues.audit_counts(cues.audit(cue_rows(s, d), speech(s, d))),
    "srt_blocks": lambda s, d: subtitles.srt_blocks(cue_rows(s, d)),
    "vtt_files": lambda s, d: subtitles.vtt(cue_rows(s, d)),
    "cache_evictions": evictions,
    "first_starts": first_starts,
    "expired_starts": expired,
    "streamed_sessions": streamed_sessions,
    "purged_jobs": purged_jobs,
}

_BASE = """ev AS (SELECT event_id, user_id AS clip_id, event_type, value, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(round(value * 6000) AS BIGINT) AS end_ms, epoch_us(ts) // 1000 AS t_ms FROM events),
speech AS (SELECT * FROM ev WHERE event_type IN ('view', 'click')),
cap AS (SELECT *, event_type || ', ' || event_id AS text FROM ev WHERE event_type IN ('purchase', 'signup')),
sam AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY t_ms, event_id) - 1 AS i, value / 500 AS x FROM ev)"""


def _merged(source: str, gap: int, to: str) -> str:
    return f"""{to}_a AS (SELECT clip_id, start_ms, end_ms, max(end_ms) OVER (PARTITION BY clip_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
{to}_b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g FROM {to}_a),
{to} AS (SELECT clip_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM {to}_b GROUP BY clip_id, g)"""


def _swept(a: str, b: str, to: str) -> str:
    one = lambda t, x, y: f"SELECT clip_id, start_ms AS t, {x} AS a, {y} AS b FROM {t} WHERE end_ms > start_ms UNION ALL SELECT clip_id, end_ms, -{x}, -{y} FROM {t} WHERE end_ms > start_ms"
    return f"""{to}_s AS (SELECT clip_id, t, sum(a) AS a, sum(b) AS b FROM ({one(a, 1, 0)} UNION ALL {one(b, 0, 1)}) GROUP BY clip_id, t),
{to} AS (SELECT clip_id, t AS start_ms, lead(t) OVER w AS end_ms, sum(a) OVER w AS a, sum(b) OVER w AS b FROM {to}_s WINDOW w AS (PARTITION BY clip_id ORDER BY t))"""


def _gaps(least: int, to: str) -> str:
    return f"""{_merged("speech", 0, to + "_m")},
{to} AS (SELECT * FROM (SELECT clip_id, end_ms AS start_ms, lead(start_ms) OVER (PARTITION BY clip_id ORDER BY start_ms) AS end_ms FROM {to}_m) WHERE end_ms - start_ms >= {least})"""


def _sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join([_BASE, *ctes]) + "\n" + select


_SPANS = ("nz AS (SELECT * FROM speech WHERE end_ms > start_ms)", _merged("nz", 0, "spans"))
_NEAR = """near AS (SELECT p.event_id, p.clip_id, p.t_ms, v.t_ms AS nearest_ms, p.t_ms - v.t_ms AS residual_ms, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t_ms - v.t_ms), v.t_ms) AS k
  FROM ev p JOIN ev v ON p.clip_id = v.clip_id AND p.event_type = 'purchase' AND v.event_type = 'view' AND abs(p.t_ms - v.t_ms) <= 36000000),
res AS (SELECT event_id, clip_id, t_ms, nearest_ms, residual_ms FROM near WHERE k = 1)"""
_POOL = """sized AS (SELECT *, max(i) OVER (PARTITION BY clip_id) + 1 AS n FROM sam),
got AS (SELECT clip_id, CASE WHEN n <= 20 THEN i ELSE ((i + 1) * 20 + n - 1) // n - 1 END AS b, max(x) AS x FROM sized GROUP BY ALL),
pool AS (SELECT clip_id, CAST(b AS BIGINT) AS b, coalesce(x, 0) AS x FROM (SELECT DISTINCT clip_id FROM sam) CROSS JOIN (SELECT unnest(range(20)) AS b) LEFT JOIN got USING (clip_id, b))"""
_FIRST = "first AS (SELECT clip_id, event_type, event_id, t_ms FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, event_type ORDER BY t_ms, event_id) AS k FROM ev) WHERE k = 1)"
_CLOCK = lambda c, mark: f"lpad(CAST({c} // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST({c} // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST({c} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({c} // 1000 % 60 AS VARCHAR), 2, '0') || '{mark}' || lpad(CAST({c} % 1000 AS VARCHAR), 3, '0')"
_BLOCKS = lambda mark: f"blocks AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY start_ms, end_ms, text) AS n, row_number() OVER (PARTITION BY clip_id ORDER BY start_ms, end_ms, text) || chr(10) || {_CLOCK('start_ms', mark)} || ' --> ' || {_CLOCK('end_ms', mark)} || chr(10) || text || chr(10) AS block FROM cap)"
_WORDS = "words AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY t_ms, event_id) - 1 AS idx, start_ms, end_ms FROM cap)"
_BETWEEN = """nx AS (SELECT *, lead(start_ms) OVER (PARTITION BY clip_id ORDER BY idx) AS until FROM words),
bt AS (SELECT n.clip_id, n.idx, any_value(n.start_ms) AS start_ms, any_value(n.end_ms) AS end_ms, any_value(until - n.end_ms) AS gap_ms,
  CASE WHEN any_value(until) IS NOT NULL THEN CAST(coalesce(sum(greatest(0, least(g.end_ms, until + 120) - greatest(g.start_ms, n.end_ms - 120))) FILTER (g.clip_id IS NOT NULL), 0) AS BIGINT) END AS silent_ms
  FROM nx n LEFT JOIN g ON n.clip_id = g.clip_id AND g.start_ms < until + 120 AND g.end_ms > n.end_ms - 120 GROUP BY n.clip_id, n.idx),
ph AS (SELECT clip_id, idx, start_ms, end_ms, coalesce(sum(CASE WHEN silent_ms >= 400 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS phrase FROM bt)"""
_AUDIT = (
    _gaps(400, "br"),
    "wide AS (SELECT clip_id, start_ms - 20 AS start_ms, end_ms + 60 AS end_ms FROM cap)",
    _swept("speech", "wide", "sw"),
    "bare AS (SELECT clip_id, start_ms, end_ms FROM sw WHERE a > 0 AND b = 0 AND end_ms IS NOT NULL)",
    _merged("bare", 0, "bm"),
    """issues AS (SELECT c.clip_id, 'over_silence' AS kind, 'warn' AS severity, greatest(c.start_ms, b.start_ms) AS t0_ms, least(c.end_ms, b.end_ms) AS t1_ms FROM cap c JOIN br b ON c.clip_id = b.clip_id AND least(c.end_ms, b.end_ms) - greatest(c.start_ms, b.start_ms) > 150
  UNION ALL SELECT clip_id, 'empty_speech', 'warn', start_ms, end_ms FROM bm WHERE end_ms - start_ms >= 300
  UNION ALL SELECT clip_id, 'zero_duration', 'warn', start_ms, end_ms FROM cap WHERE end_ms <= start_ms
  UNION ALL SELECT clip_id, 'flash_cue', 'warn', start_ms, end_ms FROM cap WHERE end_ms > start_ms AND end_ms - start_ms < 200
  UNION ALL SELECT clip_id, 'overlap', 'warn', nx, end_ms FROM (SELECT *, lead(start_ms) OVER (PARTITION BY clip_id ORDER BY start_ms, end_ms) AS nx FROM cap) WHERE end_ms > nx)""",
)

SQL = {
    "session_islands": _sql("pts AS (SELECT clip_id, start_ms, start_ms AS end_ms FROM ev)", _merged("pts", 1800000, "m"), select="SELECT * FROM m"),
    "speech_merged": _sql(_merged("speech", 2000, "m"), select="SELECT * FROM m"),
    "speech_union": _sql("s AS (SELECT * FROM speech WHERE end_ms > start_ms)", _merged("s", 0, "m"), select="SELECT * FROM m WHERE end_ms - start_ms >= 60000"),
    "silence_gaps": _sql(_gaps(250, "g"), select="SELECT * FROM g"),
    "union_length": _sql("s AS (SELECT * FROM speech WHERE end_ms > start_ms)", _merged("s", 0, "m"), select="SELECT clip_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS union_ms FROM m GROUP BY clip_id"),
    "uncovered_speech": _sql(_swept("speech", "cap", "sw"), "bare AS (SELECT clip_id, start_ms, end_ms FROM sw WHERE a > 0 AND b = 0 AND end_ms IS NOT NULL)", _merged("bare", 0, "m"), select="SELECT clip_id, start_ms, end_ms FROM m WHERE end_ms - start_ms >= 300"),
    "coverage_ratio": _sql(
        _swept("speech", "cap", "sw"),
        "c AS (SELECT clip_id, CAST(sum(CASE WHEN a > 0 THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS span_ms, CAST(sum(CASE WHEN a > 0 AND b > 0 THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS covered_ms FROM sw WHERE end_ms IS NOT NULL GROUP BY clip_id)",
        select="SELECT *, CASE WHEN span_ms > 0 THEN round(covered_ms / span_ms, 4) ELSE 1.0 END AS ratio FROM c",
    ),
    "caption_over_silence": _sql(_gaps(250, "g"), select="SELECT c.event_id, c.clip_id, c.start_ms, c.end_ms, g.start_ms AS other_start_ms, g.end_ms AS other_end_ms, least(c.end_ms, g.end_ms) - greatest(c.start_ms, g.start_ms) AS overlap_ms FROM cap c JOIN g ON c.clip_id = g.clip_id AND least(c.end_ms, g.end_ms) - greatest(c.start_ms, g.start_ms) > 150"),
    "points_in_speech": _sql(_merged("speech", 0, "m"), select="SELECT e.event_id, e.clip_id, e.t_ms, m.start_ms AS span_start_ms FROM ev e JOIN m ON e.clip_id = m.clip_id AND e.event_type = 'error' AND e.t_ms BETWEEN m.start_ms AND m.end_ms"),
    "nearest_residuals": _sql(_NEAR, select="SELECT * FROM res"),
    "residual_stats": _sql(_NEAR, select="SELECT clip_id, count(*) AS n, round(avg(residual_ms), 3) AS mean, round(stddev_pop(residual_ms), 3) AS deviation FROM res GROUP BY clip_id"),
    "padded_hull": _sql(select="SELECT clip_id, greatest(0, min(start_ms) - 1500) AS start_ms, max(end_ms) + 1500 AS end_ms FROM speech GROUP BY clip_id"),
    "split_pieces": _sql("p AS (SELECT clip_id, end_ms, unnest(range(start_ms, end_ms, 600000)) AS s FROM speech WHERE end_ms > start_ms)", select="SELECT clip_id, s AS start_ms, least(end_ms, s + 600000) AS end_ms FROM p"),
    "overlapped_windows": _sql(
        "d AS (SELECT clip_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS duration_ms FROM ev GROUP BY clip_id)",
        "p AS (SELECT clip_id, duration_ms, unnest(range(0, duration_ms, 1200000)) AS s FROM d WHERE duration_ms > 0)",
        select="SELECT clip_id, CAST(s // 1200000 AS INTEGER) AS \"window\", greatest(0, s - 60000) AS start_ms, least(duration_ms, s + 1260000) AS end_ms FROM p",
    ),
    "rms_per_hop": _sql(select="SELECT clip_id, i // 7 AS hop, round(sqrt(avg(x * x)), 6) AS rms FROM sam GROUP BY clip_id, i // 7"),
    "bucket_max_carried": _sql(
        "b AS (SELECT clip_id, i // 3 AS b, max(CASE WHEN x > 0.1 THEN x ELSE 0 END) AS x FROM sam GROUP BY clip_id, i // 3)",
        select="SELECT clip_id, b, coalesce(last_value(nullif(x, 0) IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY b ROWS UNBOUNDED PRECEDING), 0) AS x FROM b",
    ),
    "max_pooled": _sql(_POOL, select="SELECT * FROM pool"),
    "quantized_envelope": _sql(_POOL, "r AS (SELECT clip_id, quantile_cont(x, 0.99) AS p, max(x) AS m FROM pool GROUP BY clip_id)", select="SELECT clip_id, b, CAST(least(127, greatest(0, CASE WHEN (CASE WHEN p > 0 THEN p ELSE m END) > 0 THEN round_even(x * (127 / (CASE WHEN p > 0 THEN p ELSE m END)), 0) ELSE 0 END)) AS INTEGER) AS level FROM pool JOIN r USING (clip_id)"),
    "audible_end": _sql(select="SELECT clip_id, coalesce(max(CASE WHEN abs(x) > 0.5 THEN i + 1 END), max(i) + 1) AS end_i FROM sam GROUP BY clip_id"),
    "hysteresis_segments": _sql(
        "f AS (SELECT *, value / 500 AS p, max(CASE WHEN value / 500 >= 0.2 THEN t_ms END) OVER (PARTITION BY clip_id ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS on_ms FROM ev)",
        "g AS (SELECT clip_id, on_ms, min(CASE WHEN p < 0.1 THEN t_ms END) AS off_ms, max(CASE WHEN p < 0.1 THEN t_ms END) AS low_ms, max(t_ms) AS last_ms FROM f WHERE on_ms IS NOT NULL GROUP BY clip_id, on_ms)",
        "h AS (SELECT *, coalesce(low_ms - off_ms >= 3600000, false) AS closes FROM g)",
        "k AS (SELECT *, coalesce(sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY on_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM h)",
        "o AS (SELECT clip_id, min(on_ms) AS start_ms, arg_max(CASE WHEN closes THEN off_ms ELSE last_ms END, on_ms) AS end_ms FROM k GROUP BY clip_id, s)",
        select="SELECT * FROM o WHERE end_ms - start_ms > 600000",
    ),
    "energy_segments": _sql(
        "pk AS (SELECT clip_id, max(x) AS peak FROM sam GROUP BY clip_id HAVING max(x) > 0)",
        "f AS (SELECT s.clip_id, i, x > greatest(0.001, 0.3 * peak) AS is_on, x <= greatest(0.0005, 0.25 * peak) AS quiet FROM sam s JOIN pk USING (clip_id))",
        "r AS (SELECT *, i - row_number() OVER (PARTITION BY clip_id, quiet ORDER BY i) AS g FROM f)",
        "b AS (SELECT clip_id, min(i) AS a, max(i) AS z FROM r WHERE quiet GROUP BY clip_id, g HAVING count(*) >= 5)",
        "o AS (SELECT clip_id, i, coalesce((SELECT max(z) FROM b WHERE b.clip_id = f.clip_id AND b.z < f.i), -1) AS prior, coalesce((SELECT min(a) FROM b WHERE b.clip_id = f.clip_id AND b.a > f.i), (SELECT max(i) + 1 FROM sam WHERE sam.clip_id = f.clip_id)) AS e FROM f WHERE is_on)",
        "q AS (SELECT clip_id, min(i) * 30 AS start_ms, min(e) * 30 AS end_ms FROM o GROUP BY clip_id, prior)",
        select="SELECT * FROM q WHERE end_ms - start_ms >= 250",
    ),
    "clamped_phrases": _sql(
        *_SPANS,
        """c AS (SELECT p.event_id, any_value(p.clip_id) AS clip_id, any_value(p.start_ms) AS s, any_value(p.end_ms) AS e,
  min(v.start_ms) FILTER (p.start_ms BETWEEN v.start_ms AND v.end_ms) AS s_in, max(v.end_ms) FILTER (p.end_ms BETWEEN v.start_ms AND v.end_ms) AS e_in,
  min(v.start_ms) FILTER (v.end_ms >= p.start_ms - 600 AND v.start_ms <= p.end_ms) AS s_by, max(v.end_ms) FILTER (v.start_ms <= p.end_ms + 600 AND v.end_ms >= p.start_ms) AS e_by
  FROM cap p LEFT JOIN spans v ON p.clip_id = v.clip_id GROUP BY p.event_id)""",
        select="""SELECT clip_id, event_id AS phrase_id, CASE WHEN abs(s_in - s) <= 1500 THEN s_in WHEN s_in IS NULL AND abs(s_by - s) <= 600 THEN s_by ELSE s END AS start_ms,
  CASE WHEN abs(e_in - e) <= 1500 THEN e_in WHEN e_in IS NULL AND abs(e_by - e) <= 600 THEN e_by ELSE e END AS end_ms FROM c""",
    ),
    "held_tails": _sql(
        *_SPANS,
        "p AS (SELECT *, lead(start_ms) OVER (PARTITION BY clip_id ORDER BY start_ms, event_id) - 50 AS cap_ms FROM cap)",
        """h AS (SELECT p.*, (SELECT max(v.end_ms) FROM spans v WHERE v.clip_id = p.clip_id AND p.end_ms BETWEEN v.start_ms AND v.end_ms) AS cover,
  (SELECT min(q.start_ms) FROM ev q WHERE q.clip_id = p.clip_id AND q.event_type = 'error' AND q.start_ms > p.end_ms - 30) AS stop FROM p)""",
        select="SELECT clip_id, event_id AS phrase_id, start_ms, CASE WHEN event_id % 2 <> 0 OR cover IS NULL THEN end_ms ELSE greatest(end_ms, least(end_ms + CASE WHEN event_type = 'signup' THEN 3500 ELSE 1800 END, cover, coalesce(cap_ms, cover), coalesce(stop, cover))) END AS end_ms FROM h",
    ),
    "onset_issues": _sql(
        _merged("speech", 0, "m"),
        "rest AS (SELECT * FROM cap c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.clip_id = c.clip_id AND abs(m.start_ms - c.start_ms) <= 100))",
        "d AS (SELECT c.clip_id, c.event_id AS phrase_id, c.start_ms AS t, arg_min(c.start_ms - w.start_ms, abs(c.start_ms - w.start_ms) * 2 + CASE WHEN w.start_ms > c.start_ms THEN 1 ELSE 0 END) AS d FROM rest c JOIN ev w ON w.clip_id = c.clip_id AND w.event_type = 'error' AND abs(w.start_ms - c.start_ms) <= 8640000000 GROUP BY ALL)",
        select="SELECT clip_id, phrase_id, CASE WHEN d > 350 THEN 'late_start' ELSE 'early_start' END AS kind, 'info' AS severity, t AS t0_ms, t + abs(d) AS t1_ms FROM d WHERE d > 350 OR d < -500",
    ),
    "repaired_cues": _sql(select="SELECT clip_id, greatest(start_ms, lag(end_ms) OVER (PARTITION BY clip_id ORDER BY start_ms, end_ms)) AS start_ms, end_ms, text FROM cap"),
    "trimmed_cues": _sql(_gaps(250, "g"), select="SELECT c.clip_id, c.start_ms, coalesce(min(g.start_ms), c.end_ms) AS end_ms, c.text FROM cap c LEFT JOIN g ON c.clip_id = g.clip_id AND g.start_ms > c.start_ms AND g.start_ms < c.end_ms GROUP BY c.event_id, c.clip_id, c.start_ms, c.end_ms, c.text"),
    "silence_between_words": _sql(_gaps(250, "g"), _WORDS, _BETWEEN, select="SELECT * FROM bt"),
    "pause_phrases": _sql(_gaps(250, "g"), _WORDS, _BETWEEN, select="SELECT clip_id, idx, start_ms, end_ms, CAST(phrase AS BIGINT) AS phrase FROM ph"),
    "stamp_phrases": _sql(
        _WORDS,
        "nx AS (SELECT *, coalesce(lead(start_ms) OVER (PARTITION BY clip_id ORDER BY idx) - end_ms >= 1000, false) AS cut FROM words)",
        "rg AS (SELECT *, coalesce(sum(CAST(cut AS INTEGER)) OVER (PARTITION BY clip_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM nx)",
        "st AS (SELECT clip_id, r, count(*) < 3 OR arg_max(end_ms, idx) - arg_min(start_ms, idx) < 1200 AS small FROM rg GROUP BY clip_id, r)",
        "gr AS (SELECT clip_id, r, sum(CASE WHEN r > 0 AND NOT small THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS g FROM st)",
        "jo AS (SELECT clip_id, idx, start_ms, end_ms, g FROM rg JOIN gr USING (clip_id, r))",
        "fi AS (SELECT clip_id, (count(*) FILTER (g = 0) < 3 OR arg_max(end_ms, idx) FILTER (g = 0) - arg_min(start_ms, idx) FILTER (g = 0) < 1200) AND max(g) > 0 AS less FROM jo GROUP BY clip_id)",
        select="SELECT clip_id, idx, start_ms, end_ms, CAST(greatest(0, g - CASE WHEN less THEN 1 ELSE 0 END) AS BIGINT) AS phrase FROM jo JOIN fi USING (clip_id)",
    ),
    "cue_groups": _sql(
        _gaps(250, "g"),
        "words AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY t_ms, event_id) - 1 AS idx, start_ms, least(end_ms, start_ms + 60000) AS end_ms, event_id FROM ev)",
        _BETWEEN,
        "pl AS (SELECT p.clip_id, phrase, p.idx, p.start_ms, p.end_ms, CASE WHEN event_id % 13 <> 0 THEN p.idx - event_id % 3 END AS place, row_number() OVER (PARTITION BY p.clip_id, phrase ORDER BY p.idx) AS k FROM ph p JOIN words w ON p.clip_id = w.clip_id AND p.idx = w.idx)",
        """cg AS (SELECT clip_id, phrase, idx, k, place AS first, end_ms, 0 AS cue FROM pl WHERE k = 1 UNION ALL
  SELECT p.clip_id, p.phrase, p.idx, p.k, CASE WHEN n THEN p.place ELSE c.first END, p.end_ms, c.cue + CASE WHEN n THEN 1 ELSE 0 END
  FROM (SELECT p.*, c.first, c.cue, p.start_ms - c.end_ms >= 1800000 OR coalesce(p.place < c.first OR p.place - c.first >= 3, false) AS n FROM cg c JOIN pl p ON p.clip_id = c.clip_id AND p.phrase = c.phrase AND p.k = c.k + 1) p JOIN cg c ON p.clip_id = c.clip_id AND p.phrase = c.phrase AND p.k = c.k + 1)""",
        select="SELECT clip_id, CAST(phrase AS BIGINT) AS phrase, idx, CAST(cue AS BIGINT) AS cue FROM cg",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "snapped_words": _sql(
        _gaps(250, "g"),
        _WORDS,
        "n AS (SELECT w.clip_id, idx, w.start_ms AS s, w.end_ms AS e, g.start_ms AS a, g.end_ms AS b FROM words w LEFT JOIN g ON w.clip_id = g.clip_id AND g.end_ms >= w.start_ms - 400 AND g.start_ms <= w.end_ms + 400)",
        "m AS (SELECT *, greatest(s, max(CASE WHEN abs(s - b) <= 400 THEN b END) OVER (PARTITION BY clip_id, idx)) AS t FROM n)",
        "o AS (SELECT *, greatest(t, least(e, min(CASE WHEN abs(e - a) <= 400 OR (b - a >= 400 AND a - t >= 200 AND a < e) THEN a END) OVER (PARTITION BY clip_id, idx))) AS u FROM m)",
        "i AS (SELECT clip_id, idx, any_value(t) AS t, any_value(u) AS u, min(a) FILTER (b - a >= 400 AND 2 * t < a + b AND a + b < 2 * u) AS a, arg_min(b, a) FILTER (b - a >= 400 AND 2 * t < a + b AND a + b < 2 * u) AS b FROM o GROUP BY clip_id, idx)",
        select="SELECT clip_id, idx, CASE WHEN a IS NULL OR t + u <= a + b THEN t ELSE least(u, b) END AS start_ms, CASE WHEN a IS NOT NULL AND t + u <= a + b THEN greatest(t, a) ELSE u END AS end_ms FROM i",
    ),
    "shown_cues": _sql(
        _gaps(250, "g"),
        "l AS (SELECT clip_id, event_id, start_ms, end_ms, text, greatest(0, start_ms - 20) AS t FROM cap)",
        "p AS (SELECT l.*, greatest(t, (SELECT arg_min(g.end_ms, g.start_ms) FROM g WHERE g.clip_id = l.clip_id AND g.start_ms < t AND t <= g.end_ms + 30)) AS push FROM l)",
        "q AS (SELECT *, lead(push) OVER (PARTITION BY clip_id ORDER BY start_ms, end_ms) AS nx, greatest(50, push) AS st FROM p)",
        "c AS (SELECT clip_id, event_id, unnest([least(end_ms + 60, nx - 50), least(end_ms, nx - 50), least(st + 500, nx - 50)]) AS t FROM q)",
        "e AS (SELECT event_id, max(least(t, (SELECT min(g.start_ms) FROM g WHERE g.clip_id = c.clip_id AND g.start_ms - 30 <= t AND t < g.end_ms))) AS en FROM c GROUP BY event_id)",
        "r AS (SELECT q.*, CASE WHEN en > st THEN en ELSE st + 500 END AS en, CASE WHEN en > st OR nx IS NULL THEN 1 ELSE 0 END AS shown FROM q JOIN e USING (event_id))",
        "h AS (SELECT *, coalesce(sum(shown) OVER (PARTITION BY clip_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM r)",
        select="SELECT clip_id, arg_max(st, shown) AS start_ms, arg_max(en, shown) AS end_ms, list_reduce(list(text ORDER BY start_ms, end_ms), lambda h, t: CASE WHEN h = '' OR contains(t, h) THEN t ELSE h || ' ' || t END) AS text FROM h GROUP BY clip_id, k",
    ),
    "closed_cue_gaps": _sql(
        _gaps(250, "g"),
        "n AS (SELECT *, lead(start_ms) OVER (PARTITION BY clip_id ORDER BY start_ms, end_ms) AS nx FROM cap)",
        "b AS (SELECT n.event_id, g.start_ms AS a, g.end_ms AS b FROM n JOIN g ON n.clip_id = g.clip_id AND nx - n.end_ms > 100 AND g.start_ms < nx - 20 AND g.end_ms > n.end_ms + 20)",
        "c AS (SELECT n.clip_id, event_id, start_ms, nx, text, CASE WHEN coalesce(nx - end_ms <= 100, true) THEN end_ms WHEN f.a IS NULL THEN nx - 1 WHEN f.a > start_ms + 20 THEN f.a ELSE end_ms END AS end_ms FROM n LEFT JOIN (SELECT event_id, min(a) AS a FROM b GROUP BY event_id) f USING (event_id))",
        "i AS (SELECT c.clip_id, greatest(b.b, c.end_ms) AS start_ms, coalesce(lead(b.a) OVER (PARTITION BY event_id ORDER BY b.a), nx) AS u, text FROM b JOIN c USING (event_id))",
        select="SELECT clip_id, start_ms, end_ms, text FROM c UNION ALL SELECT clip_id, start_ms, u - 1, text FROM i WHERE u - start_ms > 100",
    ),
    "corrected_words": _sql(
        *_SPANS,
        _WORDS,
        "j AS (SELECT w.clip_id, idx, any_value(w.start_ms) AS s, any_value(w.end_ms) AS e, min(v.start_ms) AS a, arg_min(v.end_ms, v.start_ms) AS b FROM words w JOIN spans v ON w.clip_id = v.clip_id AND w.end_ms >= w.start_ms AND least(w.end_ms, v.end_ms + 400) - greatest(w.start_ms, v.start_ms - 400) > 0 GROUP BY w.clip_id, idx)",
        "d AS (SELECT *, a - min(s) OVER k AS d0, b - max(e) OVER k AS d1, count(*) OVER k AS n FROM j WINDOW k AS (PARTITION BY clip_id, a, b))",
        "m AS (SELECT clip_id, idx, CASE WHEN n < 2 THEN 0 ELSE CAST(greatest(-600, least(600, round(d0 + (s - a) / greatest(1, b - a) * (d1 - d0)))) AS BIGINT) END AS x FROM d)",
        select="SELECT clip_id, idx, start_ms + coalesce(x, 0) AS start_ms, end_ms + coalesce(x, 0) AS end_ms FROM words LEFT JOIN m USING (clip_id, idx)",
    ),
    "packed_chunks": _sql(
        *_SPANS,
        "c AS (SELECT clip_id, end_ms, unnest(range(start_ms, end_ms, 3600000)) AS s FROM spans)",
        "p AS (SELECT clip_id, s, least(end_ms, s + 3600000) AS e, row_number() OVER (PARTITION BY clip_id ORDER BY s, end_ms) AS k FROM c)",
        "r AS (SELECT clip_id, k, s AS a, e AS b FROM p WHERE k = 1 UNION ALL SELECT p.clip_id, p.k, CASE WHEN e - a <= 3600000 THEN a ELSE s END, CASE WHEN e - a <= 3600000 THEN greatest(b, e) ELSE e END FROM r JOIN p ON p.clip_id = r.clip_id AND p.k = r.k + 1)",
        select="SELECT clip_id, a AS start_ms, max(b) AS end_ms FROM r GROUP BY clip_id, a",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "purged_jobs": _sql(
        "j AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = 'signup' AND user_id IS NOT NULL AND ts IS NOT NULL)",
        "n AS (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS following, max(ms) OVER () AS latest FROM j)",
        select=f"SELECT user_id, event_id, ms AS created_ms, coalesce(following > ms + {24 * 60 * MINUTE}, true) AS orphan FROM n WHERE ms + {24 * 60 * MINUTE} < latest - {60 * MINUTE}",
    ),
    "streamed_sessions": _sql(
        "pts AS (SELECT clip_id, start_ms, start_ms AS end_ms FROM ev)", _merged("pts", 1800000, "m"), select="SELECT clip_id AS user_id, start_ms, end_ms + 1800000 AS end_ms, n AS n_events FROM m"
    ),
    "audit_issues": _sql(*_AUDIT, select="SELECT * FROM issues"),
    "audit_counts": _sql(*_AUDIT, select="SELECT clip_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("over_silence", "empty_speech", "zero_duration", "flash_cue", "overlap")) + ", CAST(sum(CASE WHEN kind = 'over_silence' THEN t1_ms - t0_ms ELSE 0 END) AS BIGINT) AS over_silence_ms FROM issues GROUP BY clip_id"),
    "srt_blocks": _sql(_BLOCKS(","), select="SELECT * FROM blocks"),
    "vtt_files": _sql(_BLOCKS("."), select="SELECT clip_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY n) AS body FROM blocks GROUP BY clip_id"),
    "cache_evictions": _sql(
        "f AS (SELECT event_id AS path, t_ms AS mtime, end_ms - start_ms AS size, event_type = 'purchase' AS eligible FROM ev WHERE event_type IN ('purchase', 'error'))",
        "o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY mtime, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS older FROM f WHERE eligible)",
        select="SELECT path, mtime, size FROM o WHERE (SELECT sum(size) FROM f) - older > 500000000",
    ),
    "first_starts": _sql(_FIRST, select="SELECT * FROM first"),
    "expired_starts": _sql(_FIRST, select=f"SELECT clip_id, event_type, t_ms AS start_ms FROM first WHERE {1704067200000 + 30 * 60 * MINUTE} - t_ms > {24 * 60 * MINUTE}"),
}
