"""Queries on chains and lanes of a canon in transcripts: `benchmark` is the canon, `documents` are the transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import chains, cursor, search, windows
from ..sources.shared import staged, table
from . import passages
from .passages import _words


def anchor_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first round's chain of each document, match by match, anchors anywhere."""
    index = staged(chains.flat_canon(table(spark, sf_dir, "benchmark"), "item_id"), "index")
    return chains.chain_matches(table(spark, sf_dir, "documents"), index, "doc_id", "item_id", first=None).withColumnRenamed("at", "word")


def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.collected(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def lane_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters that the first words of each document tell, of those that the canon has."""
    index = staged(chains.flat_canon(table(spark, sf_dir, "benchmark"), "item_id"), "index")
    return chains.opening_chapters(table(spark, sf_dir, "documents"), index, "doc_id", "item_id")


def long_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of the first round of lanes: documents with many words of the canon."""
    index = staged(chains.flat_canon(table(spark, sf_dir, "benchmark"), "item_id"), "index")
    return chains.long_runs(table(spark, sf_dir, "documents"), index, "doc_id", "item_id")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that has a passage, in chunks of six words of two seconds each, placed in that passage; ten of its words are a verse."""
    best = search.primary_match(passages.passage_runs(spark, sf_dir), "doc_id", "item_id").select("doc_id", "item_id")
    verses = table(spark, sf_dir, "benchmark").select("item_id", words(F.col("text")).alias("canon"))
    verses = verses.withColumn("verses", F.transform("canon", lambda _, i: F.floor(i / 10).cast("int")))
    own = table(spark, sf_dir, "documents").join(best, "doc_id").select("doc_id", "item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 6).cast("int")), lambda k: F.slice("w", 6 * k + 1, 6))
    chunks = own.select("doc_id", "item_id", F.posexplode(parts).alias("k", "w")).join(verses, "item_id")
    chunks = chunks.withColumn("start_ms", F.col("k").cast("long") * 2000).withColumn("end_ms", F.col("start_ms") + 2000)
    return cursor.passage_segments(staged(chunks, "chunks"), "doc_id", "k")


def _sentences(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+")).alias("sentence", "text"))


def tight_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document has of its best passage, as the sentences of `benchmark` in a row that it is, or nearly is."""
    heard = staged(passages.pairs(spark, sf_dir), "heard").select("doc_id", F.array_join("heard", " ").alias("text"))
    entries = _sentences(table(spark, sf_dir, "benchmark"), "item_id").select((F.col("item_id") * 1_000_000 + F.col("sentence")).alias("entry"), "text")
    return windows.tight_windows(heard, entries, "doc_id", "entry")


QUERIES = {"tight_windows": tight_windows, "passage_segments": segments, "anchor_chains": anchor_chains, "collected_runs": collected, "lane_candidates": lane_candidates, "long_lanes": long_lanes}

_INDEX = f"""cw AS (SELECT item_id, {_words("text")} AS w FROM benchmark), cb AS (SELECT item_id, w, sum(len(w)) OVER (ORDER BY item_id) - len(w) AS before FROM cw),
ix AS MATERIALIZED (SELECT item_id, pos, before + pos AS p, form FROM (SELECT item_id, before, unnest(range(len(w))) AS pos, unnest(w) AS form FROM cb)),
fr AS MATERIALIZED (SELECT form, count(*) AS n FROM ix GROUP BY form)"""
_POINTS = f"""{_INDEX},
dw AS (SELECT doc_id, {_words("text")} AS w FROM documents), da AS (SELECT doc_id, unnest(range(len(w))) AS wd, unnest(w) AS form FROM dw),
h AS MATERIALIZED (SELECT doc_id, wd, form, row_number() OVER (PARTITION BY doc_id ORDER BY wd) - 1 AS t FROM da SEMI JOIN fr USING (form)),
m AS MATERIALIZED (SELECT doc_id, t, wd, p, n FROM h JOIN ix USING (form) JOIN fr USING (form)),
s AS MATERIALIZED (SELECT a.doc_id, a.t, a.p FROM m a JOIN m b ON b.doc_id = a.doc_id AND b.t = a.t + 1 AND b.p = a.p + 1 WHERE least(a.n, b.n) <= 100),
pt AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, t) AS k FROM (SELECT * FROM m WHERE EXISTS (FROM s WHERE s.doc_id = m.doc_id AND abs(s.t - m.t) <= 25 AND abs(s.p - m.p) <= 25)))"""
#: One match a step; the band holds the ends of the last 25 places, and a value is adjacent places * 2^24 + matches.
_ENDS = f"""{_POINTS},
c AS (SELECT doc_id, k, t, wd, p, CAST(n <= 100 AS INTEGER) AS anchored, CAST(1 AS BIGINT) AS plain, CASE WHEN n <= 100 THEN CAST(1 AS BIGINT) END AS value, CAST(NULL AS BIGINT) AS t0, CAST(NULL AS BIGINT) AS p0, CAST(NULL AS BIGINT) AS t1, CAST(NULL AS BIGINT) AS p1, CAST(NULL AS INTEGER) AS f1,
    [struct_pack(p := CAST(p AS BIGINT), t := CAST(t AS BIGINT), v0 := CASE WHEN n > 100 THEN CAST(1 AS BIGINT) END, v1 := CASE WHEN n <= 100 THEN CAST(1 AS BIGINT) END)] AS band FROM pt WHERE k = 1
  UNION ALL SELECT doc_id, k, t, wd, p, anchored, v0, v1, CASE WHEN anchored = 0 THEN a.t END, CASE WHEN anchored = 0 THEN a.p END, x.t, x.p, CASE WHEN x IS NOT NULL THEN x.f END, list_append(old, struct_pack(p := CAST(p AS BIGINT), t := CAST(t AS BIGINT), v0 := v0, v1 := v1))
  FROM (SELECT *, CASE WHEN anchored = 0 THEN coalesce(a.v, 1) END AS v0, CASE WHEN anchored = 1 THEN coalesce(x.v, 1) ELSE x.v END AS v1
    FROM (SELECT *, CASE WHEN anchored = 1 THEN list_max(list_filter([struct_pack(v := a.v, p := a.p, t := a.t, f := 0), struct_pack(v := b.v, p := b.p, t := b.t, f := 1)], lambda z: z.v IS NOT NULL)) ELSE CASE WHEN b.v IS NOT NULL THEN struct_pack(v := b.v, p := b.p, t := b.t, f := 1) END END AS x
      FROM (SELECT *, list_max([struct_pack(v := z.v0 + 1 + CASE WHEN z.p = p - 1 THEN 16777216 ELSE 0 END, p := z.p, t := z.t) FOR z IN old IF z.v0 IS NOT NULL AND z.t < t AND z.p < p]) AS a,
               list_max([struct_pack(v := z.v1 + 1 + CASE WHEN z.p = p - 1 THEN 16777216 ELSE 0 END, p := z.p, t := z.t) FOR z IN old IF z.v1 IS NOT NULL AND z.t < t AND z.p < p]) AS b
        FROM (SELECT o.doc_id, o.k, o.t, o.wd, CAST(o.p AS BIGINT) AS p, CAST(o.n <= 100 AS INTEGER) AS anchored, list_filter(c.band, lambda z: z.p >= o.p - 25) AS old FROM c JOIN pt o ON o.doc_id = c.doc_id AND o.k = c.k + 1)))))"""
_BACK = f"""{_ENDS},
e AS (SELECT * FROM c WHERE value >> 24 >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY value DESC, p, t) = 1),
r AS (SELECT doc_id, t, wd, p, CASE WHEN t1 IS NOT NULL THEN t1 END AS nt, p1 AS np, f1 AS nf FROM e
  UNION ALL SELECT c.doc_id, c.t, c.wd, c.p, CASE r.nf WHEN 1 THEN c.t1 ELSE c.t0 END, CASE r.nf WHEN 1 THEN c.p1 ELSE c.p0 END, CASE r.nf WHEN 1 THEN c.f1 ELSE 0 END FROM r JOIN c ON c.doc_id = r.doc_id AND c.t = r.nt AND c.p = r.np)"""

SQL = {
    "lane_candidates": f"""WITH {_POINTS[: _POINTS.index("m AS MATERIALIZED")].rstrip().rstrip(",")},
hd AS MATERIALIZED (SELECT doc_id, form, count(*) FILTER (t < 60) AS heard FROM h GROUP BY doc_id, form), ic AS MATERIALIZED (SELECT item_id, form, count(*) AS many FROM ix GROUP BY item_id, form),
s AS (SELECT doc_id, item_id, CAST(sum(heard * many * CAST(floor(1000000 / (1 + n)) AS BIGINT)) AS BIGINT) AS score FROM hd JOIN ic USING (form) JOIN fr USING (form) WHERE heard > 0 GROUP BY doc_id, item_id)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS INTEGER) AS place FROM s) WHERE place <= 4""",
    "anchor_chains": f"WITH RECURSIVE {_BACK} SELECT doc_id, CAST(t AS BIGINT) AS t, CAST(wd AS BIGINT) AS word, CAST(p AS BIGINT) AS p FROM r",
}
