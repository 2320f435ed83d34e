"""Queries on texts: `benchmark` is the canon, `documents` and `conversations` are the transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import detector, runs, search
from ..sources.shared import table


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = text.fold(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(folded).alias("digest"), F.size(text.words(folded)).cast("long").alias("n_words"))


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", F.explode(text.words(F.col("text"))).alias("word"))
    return own.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("df"))


def passage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.passage_runs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def role_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    speaker = F.when(F.length("text") > 100, "long").otherwise("short")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", speaker.alias("kind"))
    return runs.value_runs(rows, ["conv_id"], "turn", "kind", F.floor(F.col("turn") / 256))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.words(F.col("text"))).cast("long").alias("n"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's best passage run, with the words of both sides."""
    best = search.primary_match(passage_runs(spark, sf_dir), "doc_id", "item_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    canon = table(spark, sf_dir, "benchmark").select("item_id", text.words(F.col("text")).alias("canon"))
    rows = best.join(docs, "doc_id").join(canon, "item_id")
    return rows.select("doc_id", "item_id", F.slice("w", F.col("doc_from") + 1, F.col("doc_to") - F.col("doc_from")).alias("heard"), "canon")


def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir)
    return rows.select("doc_id", "item_id", F.round(search.fuzzy_ratio(F.array_join("heard", " "), F.array_join("canon", " ")), 6).alias("ratio"))


def even_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").alias("a"), (F.col("item_id") + 10_000).alias("b"), "text")
    return search.one_to_one_words(chunks, "item_id", "a", "b", "text")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector.fragments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector.chain_runs(fragments(spark, sf_dir), "doc_id", "item_id").drop("run")


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "canon_fragments": fragments,
    "chained_runs": chained,
    "detected_claims": detected,
    "covered_items": lambda s, d: detector.covered_items(chained(s, d), "doc_id", "item_id"),
    "normalized_tokens": normalized,
    "token_stats": token_stats,
    "inverted_index": lambda s, d: search.inverted_index(table(s, d, "benchmark"), "item_id"),
    "idf_candidates": lambda s, d: search.idf_candidates(table(s, d, "documents"), table(s, d, "benchmark")),
    "passage_runs": passage_runs,
    "match_gate": lambda s, d: search.match_gate(passage_runs(s, d), "doc_id"),
    "primary_match": lambda s, d: search.primary_match(passage_runs(s, d), "doc_id", "item_id"),
    "window_matches": lambda s, d: search.window_matches(turns(s, d), "conv_id", "turn", "n", 40),
    "role_runs": role_runs,
    "even_words": even_words,
    "similarity": similarity,
    "banded_alignment": lambda s, d: search.banded_alignment(pairs(s, d), "doc_id long, item_id long"),
    "media_types": lambda s, d: table(s, d, "pages").select("page_id", text.media_type(F.regexp_replace("url", r"[?#].*$", "")).alias("kind"), text.valid_media_id(F.regexp_extract("url", "([^/]*)$", 1)).alias("valid")),
}

_SPACES = r"[\s\x0b\x{85}\p{Z}]"
_words = lambda c: f"list_filter(regexp_split_to_array(coalesce({c}, ''), '{_SPACES}+'), lambda x: x <> '')"
_drop = "".join(map(chr, [m for m in text.MARKS if m not in text.FOLDED]))
_FOLD = f"regexp_replace(regexp_replace(translate(text, '{''.join(map(chr, text.FOLDED))}{_drop}', '{''.join(map(chr, text.FOLDED.values()))}'), '^{_SPACES}+', ''), '{_SPACES}+$', '')"
_RUNS = rf"""dw AS (SELECT doc_id, {_words("text")} AS w FROM documents), cw AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
dp AS (SELECT doc_id, w, unnest(range(0, len(w) - 7)) AS place FROM dw WHERE len(w) >= 8), cp AS (SELECT item_id, w, unnest(range(0, len(w) - 7)) AS pos FROM cw WHERE len(w) >= 8),
dg AS (SELECT doc_id, place, array_to_string(w[place + 1 : place + 8], ' ') AS gram FROM dp), cg AS (SELECT item_id, pos, array_to_string(w[pos + 1 : pos + 8], ' ') AS gram FROM cp),
hit AS (SELECT doc_id, item_id, place, pos, place - pos AS diag FROM dg JOIN cg USING (gram)),
o AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 25 THEN 0 ELSE 1 END AS opens, coalesce(lead(pos) OVER w - pos > 25, true) AS next_opens, lead(pos) OVER w - pos AS step FROM hit WINDOW w AS (PARTITION BY doc_id, item_id, diag ORDER BY pos)),
n AS (SELECT *, CASE WHEN next_opens THEN 8 ELSE least(8, step) END AS own, sum(opens) OVER (PARTITION BY doc_id, item_id, diag ORDER BY pos) AS run FROM o),
r AS (SELECT doc_id, item_id, CAST(min(place) AS INTEGER) AS doc_from, CAST(max(place) + 8 AS INTEGER) AS doc_to, CAST(min(pos) AS INTEGER) AS canon_from, CAST(max(pos) + 8 AS INTEGER) AS canon_to, CAST(sum(own) AS BIGINT) AS matched FROM n GROUP BY doc_id, item_id, diag, run),
runs AS (SELECT * FROM (SELECT *, round(matched / (canon_to - canon_from), 6) AS score FROM r) WHERE matched >= 4 AND score >= 0.55)"""

_FRAGMENTS = f"""dw AS (SELECT doc_id, {_words("text")} AS w FROM documents), cw AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
dp AS (SELECT doc_id, unnest(range(len(w) - 1)) AS place, w FROM dw WHERE len(w) > 1), cp AS (SELECT item_id, unnest(range(len(w) - 1)) AS pos, w FROM cw WHERE len(w) > 1),
dg AS (SELECT doc_id, place, w[place + 1] || ' ' || w[place + 2] AS pair FROM dp), cg AS (SELECT item_id, pos, w[pos + 1] || ' ' || w[pos + 2] AS pair FROM cp),
rare AS (SELECT pair FROM cg GROUP BY pair HAVING count(*) <= 100),
hit AS (SELECT doc_id, item_id, place, pos, place - pos AS diag FROM dg JOIN cg USING (pair) JOIN rare USING (pair)),
st AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY pos) AS g FROM hit),
fr AS (SELECT doc_id, item_id, CAST(min(place) AS INTEGER) AS doc_from, CAST(max(place) + 2 AS INTEGER) AS doc_to, CAST(min(pos) AS INTEGER) AS canon_from, CAST(max(pos) + 2 AS INTEGER) AS canon_to FROM st GROUP BY doc_id, item_id, diag, g)"""
_CHAINS = f"""{_FRAGMENTS},
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY doc_from, canon_from, doc_to, canon_to) AS k FROM fr),
c AS (SELECT doc_id, item_id, k, 0 AS run, doc_from, doc_to, canon_from, canon_to, doc_to - doc_from AS matched FROM o WHERE k = 1 UNION ALL
  SELECT doc_id, item_id, k, CASE WHEN joins THEN run ELSE run + 1 END, CASE WHEN joins THEN a ELSE doc_from END, doc_to, CASE WHEN joins THEN b ELSE canon_from END, canon_to, CASE WHEN joins THEN m ELSE 0 END + doc_to - doc_from
  FROM (SELECT o.*, c.run, c.doc_from AS a, c.canon_from AS b, c.matched AS m, o.doc_from BETWEEN c.doc_to AND c.doc_to + 25 AND o.canon_from >= c.canon_to AND o.canon_from - c.canon_to < CASE WHEN c.matched < 20 THEN 6 ELSE 25 END AS joins
    FROM c JOIN o ON o.doc_id = c.doc_id AND o.item_id = c.item_id AND o.k = c.k + 1)),
ru AS (SELECT doc_id, item_id, min(doc_from) AS doc_from, CAST(arg_max(doc_to, k) AS INTEGER) AS doc_to, min(canon_from) AS canon_from, CAST(arg_max(canon_to, k) AS INTEGER) AS canon_to, CAST(max(matched) AS BIGINT) AS matched FROM c GROUP BY doc_id, item_id, run),
rs AS (SELECT * FROM (SELECT *, round(least(1.0, matched / (canon_to - canon_from)), 6) AS score FROM ru) WHERE matched >= 4 AND score >= 0.55)"""

SQL = {
    "canon_fragments": f"WITH {_FRAGMENTS} SELECT * FROM fr",
    "chained_runs": f"WITH RECURSIVE {_CHAINS} SELECT * FROM rs",
    "covered_items": f"WITH RECURSIVE {_CHAINS} SELECT doc_id, item_id, CAST(sum(matched) AS BIGINT) AS matched, min(canon_from) AS offset_from, max(canon_to) AS offset_to FROM rs GROUP BY doc_id, item_id",
    "media_types": """WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u, regexp_extract(url, '([^/]*)$', 1) AS id FROM pages),
x AS (SELECT *, lower(regexp_extract(u, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM p)
SELECT page_id, CASE ext %s ELSE 'application/octet-stream' END AS kind, regexp_full_match(id, '[A-Za-z0-9_-]{1,64}') AS valid FROM x"""
    % " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.MEDIA.items()),
    "normalized_tokens": f"SELECT doc_id, md5({_FOLD}) AS digest, CAST(len({_words(_FOLD)}) AS BIGINT) AS n_words FROM documents",
    "token_stats": f"SELECT word, count(*) AS n, count(DISTINCT conv_id) AS df FROM (SELECT conv_id, unnest({_words('text')}) AS word FROM conversations) GROUP BY word",
    "inverted_index": f"SELECT word, count(DISTINCT item_id) AS df, count(*) AS n, min(item_id) AS first_key FROM (SELECT item_id, unnest({_words('text')}) AS word FROM benchmark) GROUP BY word",
    "idf_candidates": f"""WITH i AS (SELECT item_id, unnest({_words("text")}) AS word FROM benchmark), f AS (SELECT word, CAST(floor(1000000 / (1 + count(*))) AS BIGINT) AS w FROM i GROUP BY word),
h AS (SELECT doc_id, unnest({_words("text")}[1:60]) AS word FROM documents),
s AS (SELECT doc_id, item_id, CAST(sum(w) AS BIGINT) AS score FROM h JOIN i USING (word) JOIN f USING (word) GROUP BY doc_id, item_id)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS INTEGER) AS place FROM s) WHERE place <= 3""",
    "passage_runs": f"WITH {_RUNS} SELECT * FROM runs",
    "match_gate": f"WITH {_RUNS} SELECT * EXCLUDE (best) FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM runs) WHERE score >= 0.8 OR best < 0.8",
    "primary_match": f"WITH {_RUNS} SELECT doc_id, item_id, doc_from, doc_to, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY doc_to - doc_from DESC, score DESC, doc_from, item_id) AS k FROM runs) WHERE k = 1",
    "window_matches": f"""WITH t AS (SELECT conv_id, turn, CAST(len({_words("text")}) AS BIGINT) AS n FROM conversations), s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM t)
SELECT a.conv_id, a.turn AS first, b.turn AS last FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn >= a.turn AND b.upto = a.upto - a.n + 40""",
    "role_runs": """WITH t AS (SELECT conv_id, turn, CASE WHEN length(text) > 100 THEN 'long' ELSE 'short' END AS kind FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, kind ORDER BY turn) AS g FROM t)
SELECT conv_id, kind, min(turn) AS first, max(turn) AS last, count(*) AS n FROM o GROUP BY conv_id, kind, g""",
    "even_words": f"""WITH t AS (SELECT item_id, {_words("text")} AS w FROM benchmark), p AS (SELECT item_id, w, len(w) AS n, unnest(range(len(w))) AS pos FROM t)
SELECT item_id, CAST(pos AS INTEGER) AS pos, w[pos + 1] AS word, item_id + 10000 * pos // n AS start_ms, item_id + 10000 * (pos + 1) // n AS end_ms FROM p""",
}
