"""Queries on translations in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import translation
from ..sources.shared import table
from .passages import _words, fragments


def natural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words in as many pieces as it has stretches between full stops, weighted by theirs in reverse order."""
    own = F.reverse(F.transform(F.split(F.coalesce("text", F.lit("")), "[.;!?]"), lambda x: F.size(text.words(x)).cast("bigint")))
    rows = table(spark, sf_dir, "documents").select("doc_id", translation.natural_chunks(text.words(F.col("text")), own).alias("chunks"))
    return rows.select("doc_id", F.posexplode("chunks").alias("piece", "c")).select("doc_id", "piece", "c.first", "c.last")


def translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents and passages have word by word are cues in the document's order; each passage is its own translation."""
    verses = table(spark, sf_dir, "benchmark").select("item_id", text.words(F.col("text")).alias("canon")).withColumn("translation", F.col("canon"))
    found = fragments(spark, sf_dir).join(verses, "item_id")
    order = Window.partitionBy("doc_id").orderBy("doc_from", "item_id", "canon_from", "doc_to")
    cues = found.select("doc_id", "item_id", F.row_number().over(order).alias("cue"), F.slice("canon", F.col("canon_from") + 1, F.col("canon_to") - F.col("canon_from")).alias("w"))
    return translation.translated_cues(cues, verses, "doc_id", "cue", "item_id")


QUERIES = {"natural_chunks": natural_chunks, "translated_cues": translated}

_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_BARE = lambda w: f"lower(regexp_replace({w}, '^[\\[\\]()\"''“”‘’]+|[\\[\\]()\"''“”‘’]+$', '', 'g'))"
_ENDS = lambda w: f"""(regexp_matches(regexp_replace({w}, '["''”’)\\]»]+$', ''), '[.;!?،:,]$') OR regexp_full_match(regexp_replace({w}, '["''”’)\\]»]+$', ''), '[-–—]+'))"""
_OPENED = "(length({0}) - length(replace({0}, '[', '')) - length({0}) + length(replace({0}, ']', '')))"
SQL = {
    "natural_chunks": f"""WITH RECURSIVE d AS (SELECT doc_id, {_words("text")} AS w, list_reverse(list_transform(regexp_split_to_array(coalesce(text, ''), '[.;!?]'), lambda x: greatest(1, len({_words("x")})))) AS ws FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS b, unnest(w) AS word FROM d),
f AS (SELECT *, lead(word) OVER o AS following, sum({_OPENED.format("word")}) OVER (o ROWS UNBOUNDED PRECEDING) AS depth FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY b)),
c AS MATERIALIZED (SELECT doc_id, b, CASE WHEN {_ENDS("word")} THEN -9.0::DOUBLE ELSE 0 END AS clause, CASE WHEN list_contains({_list(translation.DANGLING)}, {_BARE("word")}) THEN 100.0::DOUBLE WHEN list_contains({_list(translation.LIGHT)}, {_BARE("word")}) THEN 6.0 ELSE 0 END AS fin,
  CASE WHEN list_contains({_list(translation.OPENERS)}, {_BARE("following")}) THEN -3.0::DOUBLE ELSE 0 END AS opener, CASE WHEN depth <> 0 THEN 1000.0::DOUBLE ELSE 0 END AS bracket FROM f WHERE following IS NOT NULL),
k AS MATERIALIZED (SELECT doc_id, len(w)::BIGINT AS n, len(ws)::BIGINT AS k, ws, list_sum(ws)::BIGINT AS total, greatest(3, len(w) // len(ws)) AS room FROM d WHERE len(w) > 0),
r AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS upto, 0::BIGINT AS last FROM k WHERE k <= n UNION ALL
  SELECT doc_id, i + 1, any_value(upto), coalesce(arg_min(b, struct_pack(cost := abs(b - place) * 6.0::DOUBLE + clause + fin + opener + CASE WHEN b - last < 2 THEN 7.0::DOUBLE ELSE 0 END + CASE WHEN n - b < 2 THEN 4.0::DOUBLE ELSE 0 END + bracket, b := b)), any_value(greatest(last + 1, least(round_even(place, 0)::BIGINT, n - (k - 1 - i)))))
  FROM (SELECT s.*, c.b, c.clause, c.fin, c.opener, c.bracket FROM (SELECT r.doc_id, r.i, r.last, k.n, k.k, k.room, r.upto + k.ws[r.i + 1] AS upto, (r.upto + k.ws[r.i + 1]) * k.n / k.total AS place FROM r JOIN k USING (doc_id) WHERE r.i < k.k - 1) s
    LEFT JOIN c ON c.doc_id = s.doc_id AND c.b BETWEEN greatest(s.last + 1, floor(s.place)::BIGINT - s.room) AND least(s.n - (s.k - 1 - s.i), floor(s.place)::BIGINT + s.room)) GROUP BY doc_id, i),
p AS MATERIALIZED (SELECT r.doc_id, r.i AS piece, r.last AS a, coalesce(lead(r.last) OVER (PARTITION BY r.doc_id ORDER BY r.i), k.n) AS b FROM r JOIN k USING (doc_id)),
h AS (SELECT doc_id, piece, a, b FROM p WHERE piece = 0 UNION ALL SELECT p.doc_id, p.piece, CASE WHEN p.b - p.a = 1 AND h.b - h.a <= 10 THEN h.a ELSE p.a END, CASE WHEN p.b - p.a = 1 AND h.b - h.a <= 10 THEN h.b ELSE p.b END FROM h JOIN p ON p.doc_id = h.doc_id AND p.piece = h.piece + 1)
SELECT doc_id, piece::INTEGER AS piece, a::INTEGER AS first, b::INTEGER AS last FROM h UNION ALL SELECT doc_id, x::INTEGER, x::INTEGER, x::INTEGER + 1 FROM (SELECT doc_id, unnest(range(n)) AS x FROM k WHERE k > n)""",
}
