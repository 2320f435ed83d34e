"""Queries that go from words to captions, and that decode frames and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import assembly, cues, edges, intervals
from ..sources.shared import table
from . import passages, timeline
from .timeline import KEY, MINUTE, events, of, speech

PHRASES = {"first": ["That", "and"], "second": ["the"], "third": ["of", "and", "the"]}


def canon_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as its own canon, every fourth word misheard."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.words(F.col("text")).alias("canon"))
    own = rows.select("conv_id", "turn", F.posexplode("canon").alias("idx", "word"))
    word = F.when(F.col("idx") % 4 == 1, F.substr("word", F.lit(1), F.length("word") - 1)).otherwise(F.col("word"))
    found = assembly.canon_places(own.select("conv_id", "turn", F.col("idx").cast("long").alias("idx"), word.alias("word")), rows, ["conv_id", "turn"])
    return found.select("conv_id", "turn", "idx", "place")


def word_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cues.phrases(timeline.placed(spark, sf_dir), timeline.silence(spark, sf_dir)).withColumn("place", (F.col("event_id") % 5).cast("int"))
    rows = cues.grouped(rows.withColumn("place", F.col("place").cast("long")), 30 * MINUTE)
    extents = rows.groupBy("clip_id", "phrase").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    canon = F.transform(F.sequence(F.lit(0).cast("long"), F.col("phrase") % 5 + 2), lambda k: F.concat(F.lit("w"), k.cast("string")))
    return assembly.word_cues(rows, extents.withColumn("canon", canon)).withColumn("cue", F.col("cue").cast("long"))


def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), F.posexplode(text.words(F.col("text"))).alias("idx", "word"))
    return assembly.phrase_places(docs.withColumn("idx", F.col("idx").cast("long")), PHRASES)


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = of(spark, sf_dir, "signup").select("clip_id", F.col("event_id").alias("idx"))
    marks = of(spark, sf_dir, "purchase").select("clip_id", F.col("event_id").alias("first_idx"), (F.col("event_id") % 114).alias("chapter"))
    return assembly.tagged_with_next(points, marks)


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = events(spark, sf_dir).select("clip_id", F.floor(F.col("t_ms") / (300 * MINUTE)).alias("frame"), F.substr("event_type", F.lit(1), F.lit(1)).alias("symbol"), F.col("value").alias("p"))
    return assembly.greedy_letters(frames, "v")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("clip_id").orderBy("t_ms", "event_id")
    tokens = events(spark, sf_dir).select("clip_id", F.row_number().over(order).cast("long").alias("idx"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") + 50_000).otherwise(F.col("event_id") % 300).alias("token"))
    return assembly.timed_tokens(tokens, 50_000)


def full_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of issue of one table, counted by clip."""
    issues = cues.audit(timeline.cue_rows(spark, sf_dir), speech(spark, sf_dir)).unionByName(timeline.onsets(spark, sf_dir).drop("phrase_id"))
    return issues.groupBy("clip_id", "kind", "severity").agg(F.count("*").alias("n"), F.sum(F.col("t1_ms") - F.col("t0_ms")).alias("total_ms"))


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of buckets of three samples in whole hundredths."""
    top = timeline.QUERIES["bucket_max_carried"](spark, sf_dir)
    return top.select("clip_id", "b", F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "x")) * 100, 0).cast("int").alias("percent"))


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as groups in order of time, clicks as words without a group; forms are letters."""
    order = Window.partitionBy("clip_id").orderBy("start_ms", "end_ms")
    spans = intervals.coalesce(of(spark, sf_dir, "purchase"), KEY)
    groups = spans.select("clip_id", F.row_number().over(order).cast("long").alias("group"), "start_ms", "end_ms")
    words = of(spark, sf_dir, "click").select("clip_id", F.col("event_id").alias("idx"), "start_ms", F.col("start_ms").alias("end_ms"), (F.col("event_id") % 10).cast("string").alias("word"))
    forms = groups.select("clip_id", "group", F.explode(F.array(*(((F.col("group") * 3 + k) % 10).cast("string") for k in range(5)))).alias("word"))
    return assembly.close_holes(words, groups, forms)


QUERIES = {
    "canon_places": canon_places,
    "word_cues": word_cues,
    "opening_places": openings,
    "tagged_openings": tagged,
    "greedy_letters": letters,
    "timed_tokens": timed,
    "full_audit": full_audit,
    "probability_percent": probabilities,
    "closed_holes": holes,
}

_sql, _words = timeline._sql, passages._words
_cue_groups = timeline.SQL["cue_groups"]
_CUES = _cue_groups[: _cue_groups.rindex("SELECT clip_id, CAST(phrase")].replace("CASE WHEN event_id % 13 <> 0 THEN p.idx - event_id % 3 END AS place", "event_id % 5 AS place")
_ISSUES = timeline.SQL["audit_issues"]
_ONSETS = timeline.SQL["onset_issues"]

SQL = {
    "word_cues": _CUES
    + """,
xt AS (SELECT clip_id, phrase, min(start_ms) AS s, max(end_ms) AS e, CAST(phrase % 5 + 3 AS BIGINT) AS n FROM pl GROUP BY clip_id, phrase),
xr AS (SELECT p.clip_id, p.phrase, least(c.cue, t.n - 1) AS cue, p.idx, p.start_ms, p.end_ms, p.place, s, e, n FROM pl p JOIN cg c ON p.clip_id = c.clip_id AND p.phrase = c.phrase AND p.idx = c.idx JOIN xt t ON t.clip_id = p.clip_id AND t.phrase = p.phrase),
xq AS (SELECT clip_id, phrase, cue, arg_min(start_ms, idx) AS start_ms, arg_max(end_ms, idx) AS end_ms, min(place) AS low, any_value(s) AS s, any_value(e) AS e, any_value(n) AS n FROM xr GROUP BY clip_id, phrase, cue),
xo AS (SELECT *, count(*) OVER (PARTITION BY clip_id, phrase) AS many, greatest(0, max(CASE WHEN cue > 0 THEN low - cue END) OVER (PARTITION BY clip_id, phrase ORDER BY cue ROWS UNBOUNDED PRECEDING)) AS past FROM xq),
xf AS (SELECT *, CASE WHEN cue = 0 THEN 0 ELSE cue + least(n - many, past) END AS a FROM xo),
xg AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY clip_id, phrase ORDER BY cue), n) AS b FROM xf)
SELECT clip_id, CAST(phrase AS BIGINT) AS phrase, CAST(cue AS BIGINT) AS cue, CASE WHEN cue = 0 THEN least(start_ms, s) ELSE start_ms END AS start_ms, CASE WHEN cue = many - 1 THEN e ELSE end_ms END AS end_ms, array_to_string(list_transform(range(a, b), lambda k: 'w' || k), ' ') AS text FROM xg""",
    "opening_places": f"""WITH w AS (SELECT doc_id AS clip_id, {_words("text")} AS w FROM documents), p AS (SELECT clip_id, w, unnest(range(len(w))) AS idx FROM w)
SELECT clip_id, 'first' AS name, idx, idx + 1 AS last_idx FROM p WHERE w[idx + 1] = 'That' AND w[idx + 2] = 'and' UNION ALL
SELECT clip_id, 'second', idx, idx FROM p WHERE w[idx + 1] = 'the' UNION ALL
SELECT clip_id, 'third', idx, idx + 2 FROM p WHERE w[idx + 1] = 'of' AND w[idx + 2] = 'and' AND w[idx + 3] = 'the'""",
    "tagged_openings": _sql(
        "m AS (SELECT clip_id, event_id AS f, event_id % 114 AS chapter FROM ev WHERE event_type = 'purchase')",
        select="SELECT clip_id, event_id AS idx, coalesce((SELECT arg_min(chapter, f) FROM m WHERE m.clip_id = ev.clip_id AND f > event_id), (SELECT arg_min(chapter, f) FROM m WHERE m.clip_id = ev.clip_id)) AS chapter FROM ev WHERE event_type = 'signup'",
    ),
    "greedy_letters": _sql(
        "f AS (SELECT clip_id, t_ms // 18000000 AS frame, event_type[1:1] AS symbol, value FROM ev QUALIFY row_number() OVER (PARTITION BY clip_id, t_ms // 18000000 ORDER BY value DESC, event_type[1:1]) = 1)",
        "g AS (SELECT *, lag(symbol) OVER (PARTITION BY clip_id ORDER BY frame) AS before FROM f)",
        select="SELECT clip_id, string_agg(symbol, '' ORDER BY frame) AS letters FROM g WHERE before IS DISTINCT FROM symbol AND symbol <> 'v' GROUP BY clip_id",
    ),
    "timed_tokens": _sql(
        "t AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY t_ms, event_id) AS idx, CASE WHEN event_id % 5 = 0 THEN event_id * 20 END AS ms FROM ev)",
        "g AS (SELECT *, last_value(CASE WHEN ms IS NOT NULL THEN idx END IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS a, last_value(ms IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS s, first_value(ms IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM t)",
        select="SELECT clip_id, any_value(s) AS start_ms, coalesce(any_value(e), any_value(s) + 500) AS end_ms, min(idx) AS first_idx, count(*) AS n FROM g WHERE ms IS NULL AND a IS NOT NULL GROUP BY clip_id, a",
    ),
    "full_audit": f"WITH i AS ({_ISSUES} UNION ALL SELECT clip_id, kind, severity, t0_ms, t1_ms FROM ({_ONSETS})) SELECT clip_id, kind, severity, count(*) AS n, CAST(sum(t1_ms - t0_ms) AS BIGINT) AS total_ms FROM i GROUP BY clip_id, kind, severity",
    "probability_percent": f"WITH b AS ({timeline.SQL['bucket_max_carried']}) SELECT clip_id, b, CAST(round_even(least(1, greatest(0, x)) * 100, 0) AS INTEGER) AS percent FROM b",
}
