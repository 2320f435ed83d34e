"""Queries of lookups, gates, memberships and column functions. `benchmark` is a canon of ten verses a chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import detector, intervals, lookups, runs, search
from ..sources import subtitles
from ..sources.shared import table
from . import passages, timeline
from .timeline import KEY, MINUTE, captions, cue_rows, events, of, samples, speech, words_of

OPENERS = {"first": ["That", "and"], "second": ["Is"], "third": ["De"]}


def canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 10).alias("chapter"), (F.col("item_id") % 10 + 1).alias("verse"), "text")


def verse_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", (F.col("clip_id") % 7).alias("chapter"), (F.col("event_id") % 12 + 1).alias("verse"))
    return lookups.with_default(rows, canon(spark, sf_dir), ["chapter", "verse"], "text").select("event_id", "chapter", "verse", "text")


def chapter_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("chapter"), F.col("n_name").alias("name"))
    return lookups.with_default(events(spark, sf_dir).select("event_id", F.col("clip_id").alias("chapter")), names, ["chapter"], "name")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    def copies(kind: str) -> DataFrame:
        rows = of(spark, sf_dir, kind).groupBy("clip_id").agg(F.count("*").alias("size"), F.max("event_id").alias("m"))
        return rows.select("clip_id", "size", F.when(F.col("m") % 3 > 0, F.col("m") % 40).alias("total"))

    return lookups.stored_copies(copies("view"), copies("purchase"), "clip_id")


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = events(spark, sf_dir).select("clip_id", F.when(F.col("event_type") == "signup", "recited").otherwise("other").alias("kind"), (F.col("clip_id") * 100_000).alias("voiced_ms"))
    return lookups.validated(results, of(spark, sf_dir, "purchase"), "clip_id")


def loud(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import signal

    levels = signal.rms_per_hop(samples(spark, sf_dir), KEY, 7).select("clip_id", F.col("hop").alias("window"), F.round("rms", 6).alias("rms"))
    return lookups.loud_windows(levels, 0.005, 0.6)


def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = passages.turns(spark, sf_dir)
    wanted = turns.groupBy("conv_id").agg(F.sum("n").alias("all")).select("conv_id", F.explode(F.expr("sequence(0, all + 5, 7)")).alias("place"))
    return lookups.chunk_of_word(turns, wanted, "conv_id", "turn", "n", "place")


def no_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = captions(spark, sf_dir).select("clip_id", "event_id", F.floor(F.col("start_ms") / (600 * MINUTE)).alias("chunk"), "start_ms", "end_ms")
    chunks = rows.groupBy("clip_id", "chunk").agg(F.max("end_ms").alias("end_ms"))
    return lookups.without_overlap(rows, chunks)


def final_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = speech(spark, sf_dir).groupBy("clip_id").agg(F.max("end_ms").alias("speech_end_ms"), F.max(F.col("start_ms") + 500).alias("audible_end_ms"), (F.max("end_ms") + 60_000).alias("duration_ms"))
    return lookups.final_hold(cue_rows(spark, sf_dir), ends)


def card(spark: SparkSession, sf_dir: str) -> DataFrame:
    # of equally high events the first; one without a value or an id is no last passage
    valued = F.when(F.col("value").isNotNull() & F.col("event_id").isNotNull(), F.struct("value", (-F.col("event_id")).alias("first")))
    top, hundredths = F.max("value"), F.max("value") * 100
    # a double's hundredths are rounded, not the digits that it shows
    score = F.when(F.abs(hundredths) < float("inf"), F.round(hundredths) / 100).otherwise(top)
    matches = events(spark, sf_dir).groupBy("clip_id").agg(F.min("event_id").alias("first"), F.max_by("event_id", valued).alias("last"), score.alias("score"))
    return lookups.result_card(matches, of(spark, sf_dir, "signup"))


def playhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.shown_at(of(spark, sf_dir, "error").select("event_id", "clip_id", "t_ms"), captions(spark, sf_dir).select("clip_id", "start_ms", "end_ms"))


def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.neighbour_padded(intervals.coalesce(speech(spark, sf_dir), KEY), 40 * MINUTE)


def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("clip_id").orderBy("t_ms", "event_id")
    polls = events(spark, sf_dir).select("clip_id", F.row_number().over(order).cast("long").alias("poll"), "event_type")
    return lookups.missed_streaks(polls, "clip_id", "poll", F.col("event_type").isin("view", "click"))


def waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of(spark, sf_dir, "error").select("event_id", (F.col("event_id") % 5).alias("attempt"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 20_000).alias("retry_after_ms"))
    return lookups.waits(rows)


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import state

    rows = events(spark, sf_dir).select("clip_id", "event_id", F.col("event_type").alias("stage"))
    return state.progress(rows, "clip_id", "event_id", {"view": 10, "click": 40, "purchase": 80}).select("event_id", "clip_id", "percent")


def voiced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select("clip_id", "i", (F.col("x") > 0.2).alias("voiced"))
    return runs.value_runs(rows, KEY, "i", "voiced", F.floor(F.col("i") / 65_536)).filter("voiced").select("clip_id", "first", "last", "n")


def energy_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = intervals.merge(speech(spark, sf_dir), KEY, 1500)
    return merged.groupBy("clip_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).filter("end_ms - start_ms >= 4000")


def overlap_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.slice(text.words(F.col("text")), 1, 6).alias("hole"), text.words(F.lower("text")).alias("form"))
    return lookups.overlap_share(rows, "hole", "form").select("conv_id", "turn", "share")


def partial_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passages.pairs(spark, sf_dir)
    return rows.select("doc_id", "item_id", F.round(search.fuzzy_partial_ratio(F.array_join(F.slice("heard", 1, 12), " "), F.array_join("canon", " ")), 6).alias("ratio"))


def _own_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text.words(F.col("text")).alias("w"), text.words(F.substr("text", F.lit(1), F.lit(150))).alias("v"))


def clause_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _own_words(spark, sf_dir).select("item_id", text.clause_span(F.col("w"), F.lit(6), F.lit(9)).alias("s"))
    return rows.select("item_id", "s.first", "s.last")


def trimmed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _own_words(spark, sf_dir).select("item_id", text.trimmed(F.col("w"), F.col("v"), F.lit(3), F.lit(8)).alias("t"))
    return rows.select("item_id", "t.own", "t.other")


def opener_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.once(text.words(F.col("text")), lambda w: text.leading_openers(w, OPENERS)), ",").alias("openers"))
    return rows


def stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = text.without_openings(text.words(F.col("text")), OPENERS, ["of", "the"])
    rows = table(spark, sf_dir, "documents").select("doc_id", own.alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("digest"))


def stripped_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages in documents without their opening phrases."""
    own = text.without_openings(text.words(F.col("text")), OPENERS, ["of", "the"])
    docs = table(spark, sf_dir, "documents").select("doc_id", own.alias("w"))
    return detector.detect(docs, table(spark, sf_dir, "benchmark"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = intervals.merge(speech(spark, sf_dir), KEY, 60 * MINUTE).select("clip_id", "start_ms", "end_ms")
    return intervals.request_plan(spans, of(spark, sf_dir, "view"), KEY, 20 * MINUTE)


def halved_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged speech as requests that are refused if they are longer than their clip's limit, halved until they are not."""
    spans = intervals.merge(speech(spark, sf_dir), KEY, 60 * MINUTE).select("clip_id", "start_ms", "end_ms")
    limit = (10 + F.col("clip_id") % 50) * MINUTE
    return intervals.halved(spans, KEY, F.col("end_ms") - F.col("start_ms") > limit, 15 * MINUTE)


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, other = F.col("event_type"), F.when(F.col("event_id") % 3 > 0, F.upper("event_type"))
    return events(spark, sf_dir).select("event_id", *(subtitles.in_language(own, other, x).alias(x) for x in ("own", "translation", "both")))


def column_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates and small parsers over urls and the words of conversations' first lines."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(text.words(F.col("text")), F.lit(1)).alias("word"), F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 0, ":7").otherwise("")).alias("ref"))
    return rows.select(
        "conv_id",
        "turn",
        F.coalesce(text.ends_clause(F.col("word")), F.lit(False)).alias("ends"),
        F.array_join(text.reference(F.col("ref")).cast("array<string>"), "/").alias("ref"),
        text.error_class(F.col("conv_id") % 200 + 350).alias("class"),
        text.is_soundtrack(F.concat(F.lit("clip"), F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 0, ".MP4.audio.ogg").otherwise(".mp4"))).alias("soundtrack"),
        text.video_of(F.concat(F.lit("a.mov.audio.ogg"), F.when(F.col("turn") % 2 == 0, "").otherwise(".x"))).alias("video"),
        F.size(text.json_words(F.concat(F.lit('[{"text": "'), F.col("word"), F.lit('", "start": 1, "end": '), (F.col("turn") % 3).cast("string"), F.lit("}]")))).alias("words"),
        text.clamped((F.col("turn") * 40).cast("string"), 12, 96, 30).alias("clamped"),
    )


QUERIES = {
    "halved_requests": halved_requests,
    "verse_texts": verse_texts,
    "chapter_names": chapter_names,
    "verse_range": lambda s, d: lookups.verses(canon(s, d), 1, 3, 7),
    "text_index": lambda s, d: lookups.text_index(table(s, d, "documents").filter("text is not null"), "doc_id", F.md5(text.fold(F.col("text")))),
    "sample_slice": lambda s, d: samples(s, d).filter(F.col("i").between(5, 11)),
    "stored_copies": stored,
    "tight_matches": lambda s, d: search.primary_match(passages.passage_runs(s, d), "doc_id", "item_id").filter("score >= 0.85"),
    "validated_results": validated,
    "long_enough": lambda s, d: lookups.long_enough(speech(s, d).select("clip_id", "event_id", "start_ms", "end_ms"), 60_000, 25 * 1440 * MINUTE),
    "loud_windows": loud,
    "inside_by_middle": lambda s, d: lookups.inside_by_middle(words_of(s, d), speech(s, d)),
    "chunk_of_word": word_chunks,
    "without_overlap": no_overlap,
    "final_hold": final_hold,
    "most_common": lambda s, d: lookups.most_common(events(s, d), "clip_id", "event_type"),
    "cue_signature": lambda s, d: lookups.signature(cue_rows(s, d)),
    "result_card": card,
    "shown_at": playhead,
    "neighbour_padded": padded,
    "missed_streaks": streaks,
    "retry_waits": waits,
    "stage_progress": progress,
    "voiced_runs": voiced_runs,
    "energy_hull": energy_hull,
    "overlap_shares": overlap_shares,
    "partial_similarity": partial_similarity,
    "clause_spans": clause_spans,
    "trimmed_texts": trimmed_texts,
    "opener_names": opener_names,
    "column_functions": column_functions,
    "cue_languages": languages,
    "stripped_words": stripped,
    "stripped_claims": stripped_claims,
    "request_plan": requests,
}

_words, _sql, _merged, _SPANS, _WORDS = passages._words, timeline._sql, timeline._merged, timeline._SPANS, timeline._WORDS
_ENDS = lambda w: f"(regexp_matches(regexp_replace({w}, '[\"''”’)\\]»]+$', ''), '[.;!?،:,]$') OR regexp_matches(regexp_replace({w}, '[\"''”’)\\]»]+$', ''), '^[-–—]+$'))"
_CLAUSE = lambda w, a, b: f"""len({w}) AS n, greatest(0, least({a}, len({w}) - 1)) AS a, greatest(greatest(0, least({a}, len({w}) - 1)) + 1, least({b}, len({w}))) AS b"""
_SPAN = lambda w: f"list_max(list_filter(range(a + 1), lambda k: k = 0 OR {_ENDS(f'{w}[k]')})) AS f, list_min(list_filter(range(b, n + 1), lambda k: k = n OR {_ENDS(f'{w}[k]')})) AS l"

SQL = {
    "halved_requests": _sql(_merged("speech", 3600000, "m"), select="""SELECT * FROM (WITH RECURSIVE r AS (SELECT clip_id, start_ms, end_ms, 0 AS depth FROM m UNION ALL
  SELECT clip_id, CASE h WHEN 0 THEN start_ms ELSE start_ms + (end_ms - start_ms) // 2 END, CASE h WHEN 0 THEN start_ms + (end_ms - start_ms) // 2 ELSE end_ms END, depth + 1
  FROM r, (VALUES (0), (1)) x(h) WHERE end_ms - start_ms > (10 + clip_id % 50) * 60000 AND end_ms - start_ms >= 900000 AND depth < 3)
  SELECT *, end_ms - start_ms > (10 + clip_id % 50) * 60000 AS failed FROM r WHERE NOT (end_ms - start_ms > (10 + clip_id % 50) * 60000 AND end_ms - start_ms >= 900000 AND depth < 3))"""),
    "stripped_words": f"""WITH t AS (SELECT doc_id, {_words("text")} AS w FROM documents), a AS (SELECT *, CASE WHEN w[1] = 'That' AND w[2] = 'and' THEN 2 ELSE 0 END AS i FROM t),
b AS (SELECT *, i + CASE WHEN w[i + 1] = 'Is' THEN 1 ELSE 0 END AS j FROM a), c AS (SELECT doc_id, w[j + CASE WHEN w[j + 1] = 'De' THEN 2 ELSE 1 END :] AS w FROM b),
d AS (SELECT doc_id, list_filter(w, lambda x, i: NOT coalesce((x = 'of' AND w[i + 1] = 'the') OR (x = 'the' AND i > 1 AND w[i - 1] = 'of'), false)) AS w FROM c)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, ' ')) AS digest FROM d""",
    "cue_languages": _sql(select="SELECT event_id, event_type AS own, CASE WHEN event_id % 3 > 0 THEN upper(event_type) ELSE event_type END AS translation, CASE WHEN event_id % 3 > 0 THEN event_type || chr(10) || upper(event_type) ELSE event_type END AS \"both\" FROM ev"),
    "verse_texts": _sql("c AS (SELECT item_id // 10 AS chapter, item_id % 10 + 1 AS verse, text FROM benchmark)", select="SELECT event_id, clip_id % 7 AS chapter, event_id % 12 + 1 AS verse, coalesce(c.text, '') AS text FROM ev LEFT JOIN c ON c.chapter = clip_id % 7 AND c.verse = event_id % 12 + 1"),
    "chapter_names": _sql(select="SELECT event_id, clip_id AS chapter, coalesce(n_name, '') AS name FROM ev LEFT JOIN nation ON n_nationkey = clip_id"),
    "verse_range": "SELECT item_id // 10 AS chapter, item_id % 10 + 1 AS verse, text FROM benchmark WHERE item_id // 10 = 1 AND item_id % 10 + 1 BETWEEN 3 AND 7",
    "text_index": f"SELECT md5({passages._FOLD}) AS text, max(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "sample_slice": _sql(select="SELECT * FROM sam WHERE i BETWEEN 5 AND 11"),
    "stored_copies": _sql(
        "c AS (SELECT event_type, clip_id, count(*) AS size, CASE WHEN max(event_id) % 3 > 0 THEN max(event_id) % 40 END AS total FROM ev GROUP BY event_type, clip_id)",
        "w AS (SELECT * FROM c WHERE coalesce(size >= total, true))",
        select="SELECT clip_id, coalesce(a.size, b.size) AS size, CASE WHEN a.clip_id IS NOT NULL THEN a.total ELSE b.total END AS total, CASE WHEN a.clip_id IS NOT NULL THEN 'memory' ELSE 'disk' END AS source FROM (SELECT * FROM w WHERE event_type = 'view') a FULL JOIN (SELECT * FROM w WHERE event_type = 'purchase') b USING (clip_id)",
    ),
    "tight_matches": f"WITH {passages._RUNS} SELECT doc_id, item_id, doc_from, doc_to, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY doc_to - doc_from DESC, score DESC, doc_from, item_id) AS k FROM runs) WHERE k = 1 AND score >= 0.85",
    "validated_results": _sql(
        "a AS (SELECT clip_id, count(*) FILTER (event_type = 'purchase') AS n, coalesce(sum(end_ms - start_ms) FILTER (event_type = 'purchase'), 0) AS al, count(*) FILTER (event_type = 'signup') AS r FROM ev GROUP BY clip_id)",
        select="SELECT clip_id, n AS n_words, CASE WHEN n < 10 THEN 'too_few_words' WHEN al < 0.35 * clip_id * 100000 THEN 'too_little_aligned' WHEN r = 0 THEN 'nothing_recited' ELSE 'ok' END AS status FROM a",
    ),
    "long_enough": _sql("c AS (SELECT clip_id FROM speech GROUP BY clip_id HAVING max(end_ms) - min(start_ms) >= 2160000000)", select="SELECT clip_id, event_id, start_ms, end_ms FROM speech JOIN c USING (clip_id) WHERE end_ms - start_ms >= 60000"),
    "loud_windows": _sql("l AS (SELECT clip_id, i // 7 AS \"window\", round(sqrt(avg(x * x)), 6) AS rms FROM sam GROUP BY clip_id, i // 7)", select="SELECT * FROM l QUALIFY rms >= greatest(0.005, 0.6 * max(rms) OVER (PARTITION BY clip_id))"),
    "inside_by_middle": _sql(_WORDS, select="SELECT w.clip_id, idx, w.start_ms, w.end_ms, s.start_ms AS cue_start_ms, s.end_ms AS cue_end_ms FROM words w JOIN speech s ON w.clip_id = s.clip_id AND w.start_ms + w.end_ms BETWEEN 2 * (s.start_ms - 20) AND 2 * (s.end_ms + 20)"),
    "chunk_of_word": f"""WITH t AS (SELECT conv_id, turn, CAST(len({_words("text")}) AS BIGINT) AS n FROM conversations), s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM t),
p AS (SELECT conv_id, unnest(range(0, CAST(sum(n) AS BIGINT) + 6, 7)) AS place FROM t GROUP BY conv_id)
SELECT conv_id, place, turn FROM p JOIN s USING (conv_id) WHERE place >= upto - n AND place < upto""",
    "without_overlap": _sql(
        "r AS (SELECT clip_id, event_id, start_ms // 36000000 AS chunk, start_ms, end_ms FROM cap)",
        "b AS (SELECT clip_id, chunk + 1 AS chunk, max(end_ms) AS e FROM r GROUP BY clip_id, chunk)",
        select="SELECT clip_id, event_id, chunk, start_ms, end_ms FROM r LEFT JOIN b USING (clip_id, chunk) WHERE e IS NULL OR start_ms >= e",
    ),
    "final_hold": _sql(
        "e AS (SELECT clip_id, least(greatest(max(end_ms), max(start_ms + 500)), max(end_ms) + 60000) AS u FROM speech GROUP BY clip_id)",
        "l AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY start_ms DESC, end_ms DESC) AS k FROM cap)",
        select="SELECT clip_id, start_ms, CASE WHEN k = 1 THEN greatest(end_ms, u) ELSE end_ms END AS end_ms, text FROM l LEFT JOIN e USING (clip_id)",
    ),
    "most_common": _sql("c AS (SELECT clip_id, event_type, count(*) AS n FROM ev GROUP BY clip_id, event_type)", select="SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, event_type) = 1"),
    "cue_signature": _sql(select="SELECT clip_id, count(*) AS n, CAST(sum(start_ms) AS BIGINT) AS start_sum_ms, CAST(sum(end_ms) AS BIGINT) AS end_sum_ms FROM cap GROUP BY clip_id"),
    "result_card": _sql(
        "m AS (SELECT clip_id, greatest(0, arg_max(event_id, value) - min(event_id) + 1) AS passages, round(max(value), 2) AS score FROM ev GROUP BY clip_id)",
        select="SELECT clip_id, passages, score, (SELECT count(*) FROM ev e WHERE e.clip_id = m.clip_id AND event_type = 'signup') AS n_cues FROM m",
    ),
    "shown_at": _sql("p AS (SELECT e.event_id, e.clip_id, e.t_ms, c.start_ms AS a, c.end_ms AS b FROM ev e JOIN cap c ON e.event_type = 'error' AND e.clip_id = c.clip_id AND c.start_ms <= e.t_ms AND e.t_ms < c.end_ms)", select="SELECT event_id, clip_id, t_ms, a AS cue_start_ms, b AS cue_end_ms FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY a, b) = 1"),
    "neighbour_padded": _sql(
        *_SPANS,
        "n AS (SELECT *, start_ms - lag(end_ms) OVER w AS ga, lead(start_ms) OVER w - end_ms AS gb FROM spans WINDOW w AS (PARTITION BY clip_id ORDER BY start_ms, end_ms))",
        select="SELECT clip_id, CASE WHEN ga IS NULL THEN greatest(0, start_ms - 2400000) ELSE start_ms - CASE WHEN ga < 4800000 THEN ga // 2 ELSE 2400000 END END AS start_ms, end_ms + CASE WHEN gb IS NULL OR gb >= 4800000 THEN 2400000 ELSE gb // 2 END AS end_ms FROM n",
    ),
    "missed_streaks": _sql(
        "p AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY t_ms, event_id) AS poll, event_type IN ('view', 'click') AS missed FROM ev)",
        "g AS (SELECT *, coalesce(max(CASE WHEN NOT missed THEN poll END) OVER (PARTITION BY clip_id ORDER BY poll ROWS UNBOUNDED PRECEDING), 0) AS good FROM p)",
        select="SELECT clip_id, min(poll) AS given_up FROM g WHERE missed AND poll - good >= 5 GROUP BY clip_id",
    ),
    "retry_waits": _sql(select="SELECT event_id, event_id % 5 AS attempt, CASE WHEN event_id % 3 = 0 THEN event_id % 20000 END AS retry_after_ms, CASE WHEN event_id % 3 = 0 THEN least(10000, event_id % 20000) ELSE 3000 * (1 << CAST(event_id % 5 AS INTEGER)) END AS wait_ms FROM ev WHERE event_type = 'error'"),
    "stage_progress": _sql(select="SELECT event_id, clip_id, max(CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 40 WHEN 'purchase' THEN 80 END) OVER (PARTITION BY clip_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS percent FROM ev"),
    "voiced_runs": _sql("r AS (SELECT clip_id, i, i - row_number() OVER (PARTITION BY clip_id ORDER BY i) AS g FROM sam WHERE x > 0.2)", select="SELECT clip_id, min(i) AS first, max(i) AS last, count(*) AS n FROM r GROUP BY clip_id, g"),
    "energy_hull": _sql(select="SELECT clip_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM speech GROUP BY clip_id HAVING max(end_ms) - min(start_ms) >= 4000"),
    "overlap_shares": f"""WITH t AS (SELECT conv_id, turn, {_words("text")}[1:6] AS h, {_words("lower(text)")} AS f FROM conversations)
SELECT conv_id, turn, CASE WHEN len(h) > 0 THEN round(len(list_filter(h, lambda x: list_contains(f, x))) / len(h), 6) ELSE 0.0 END AS share FROM t""",
    "clause_spans": f"WITH t AS (SELECT item_id, {_words('text')} AS w FROM benchmark), c AS (SELECT item_id, w, {_CLAUSE('w', 6, 9)} FROM t), s AS (SELECT item_id, n, {_SPAN('w')} FROM c) SELECT item_id, CAST(CASE WHEN n > 0 THEN f ELSE 0 END AS INTEGER) AS first, CAST(CASE WHEN n > 0 THEN l ELSE 0 END AS INTEGER) AS last FROM s",
    "trimmed_texts": f"""WITH t AS (SELECT item_id, {_words("text")} AS w, {_words("text[1:150]")} AS v FROM benchmark),
p AS (SELECT *, CASE WHEN len(v) > 0 AND len(v) <> len(w) THEN CAST(round_even(3 * len(v) / len(w), 0) AS INTEGER) ELSE 3 END AS x, CASE WHEN len(v) > 0 AND len(v) <> len(w) THEN CAST(round_even(8 * len(v) / len(w), 0) AS INTEGER) ELSE 8 END AS y FROM t),
c AS (SELECT item_id, w, v, {_CLAUSE("v", "x", "y")} FROM p), s AS (SELECT *, {_SPAN("v")} FROM c)
SELECT item_id, array_to_string(w[4:8], ' ') AS own, CASE WHEN n > 0 THEN array_to_string(v[f + 1 : l], ' ') ELSE '' END AS other FROM s""",
    "opener_names": f"""WITH t AS (SELECT doc_id, {_words("text")} AS w FROM documents), a AS (SELECT *, CASE WHEN w[1] = 'That' AND w[2] = 'and' THEN 2 ELSE 0 END AS i FROM t),
b AS (SELECT *, i + CASE WHEN w[i + 1] = 'Is' THEN 1 ELSE 0 END AS j FROM a), c AS (SELECT *, coalesce(w[j + 1] = 'De', false) AS k FROM b)
SELECT doc_id, array_to_string(list_filter([CASE WHEN i > 0 THEN 'first' END, CASE WHEN j > i THEN 'second' END, CASE WHEN k THEN 'third' END], lambda x: x IS NOT NULL), ',') AS openers FROM c""",
    "column_functions": f"""WITH t AS (SELECT conv_id, turn, {_words("text")}[2] AS word, conv_id || ':' || turn || CASE WHEN turn % 2 = 0 THEN ':7' ELSE '' END AS ref, conv_id % 200 + 350 AS status FROM conversations)
SELECT conv_id, turn, coalesce({_ENDS("word")}, false) AS ends, CASE WHEN turn % 2 = 0 THEN replace(ref, ':', '/') END AS ref, CASE WHEN status = 429 OR status >= 500 THEN 'transient' WHEN status >= 400 THEN 'permanent' END AS class,
turn % 2 = 0 AS soundtrack, CASE WHEN turn % 2 = 0 THEN 'a.mov' ELSE 'a.mov.audio.ogg.x' END AS video, CAST(CASE WHEN word IS NOT NULL AND turn % 3 >= 1 THEN 1 ELSE 0 END AS INTEGER) AS words, CAST(greatest(12, least(96, turn * 40)) AS DOUBLE) AS clamped FROM t""",
}
