"""Passages of a canon that a transcript runs through: chains of matched words, repeats, and rival claims.

A transcript is a row of `docs` (key doc), a chapter of the canon a row of `canon` (key item); word places count from 0.
Everything starts from adjacent word pairs that both sides have, so single common words never meet the canon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.shared import staged
from . import intervals

#: Word pairs that the canon has more often are no anchors of `fragments`, where the caller doesn't lift that.
COMMON = 100
#: Canon words that a chain leaps over at most, and a chain of fewer than SETTLED words.
REACH, REACH_EARLY, SETTLED = 25, 6, 20
#: Words of a run, and the share of its span that they cover.
LEAST, SCORE = 4, 0.55
#: A repeat is looked for where a run scores so much; it needs this share of the run's span, and so many words unless the span is shorter.
SURE, REPEATED, AT_LEAST = 0.85, 0.7, 6
#: Share of a claim that another one may take.
TAKEN, SHARED = 0.3, 0.5
#: Tasks for the hits of each partition of the transcripts.
PARTS = 4
#: Word places of a cell in which spans meet.
CELL = 256


def pairs(df: DataFrame, key: str, place: str) -> DataFrame:
    """(key, place, pair): each two adjacent words of `text`, or of the array `w` in its place; a null or one-word text has none."""
    own = df.select(key, F.col("w") if "w" in df.columns else words(F.col("text")).alias("w"))
    both = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    # no filter by size, which would work the words out a second time
    return own.select(key, F.posexplode(F.when(F.size("w") > 1, both)).alias(place, "pair"))


def fragments(docs: DataFrame, canon: DataFrame, doc: str, item: str, most: int | None = COMMON) -> DataFrame:
    """(doc, item, doc_from, doc_to, canon_from, canon_to): stretches of two words or more that both sides have word by word.

    Pairs that the canon has over `most` times are no anchors, so a transcript's place meets `most` canon places at most; with
    None every pair is one, however often the canon has it."""
    index = pairs(canon, item, "pos")
    if most is not None:
        rare = index.groupBy("pair").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("pair")
        index = index.join(rare, "pair", "left_semi")
    hits = pairs(docs, doc, "at").join(index, "pair").select(doc, item, "at", "pos", (F.col("at") - F.col("pos")).alias("diagonal"))
    # the hits of a part of the input are a task's, so its memory doesn't grow with the input; chain_runs takes them as they are dealt
    hits = hits.repartition(max(PARTS * docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), doc, item)
    over = Window.partitionBy(doc, item, "diagonal").orderBy("pos")
    hits = hits.withColumn("stretch", F.col("pos") - F.row_number().over(over))
    found = hits.groupBy(doc, item, "diagonal", "stretch").agg(F.min("at").alias("doc_from"), (F.max("at") + 2).alias("doc_to"), F.min("pos").alias("canon_from"), (F.max("pos") + 2).alias("canon_to"))
    return found.select(doc, item, "doc_from", "doc_to", "canon_from", "canon_to")


def chain_runs(found: DataFrame, doc: str, item: str, reach: int = REACH, early: int = REACH_EARLY, settled: int = SETTLED, least: int = LEAST, score: float = SCORE) -> DataFrame:
    """(doc, item, run, doc_from, doc_to, canon_from, canon_to, matched, score): fragments chained to runs.

    In order of the transcript a fragment joins the run before it if it lies behind it on both sides, its canon words
    leap at most `reach` (a run of fewer than `settled` words: `early`), and the transcript no more than `reach`. A run
    needs `least` matched words, and `score`, matched words over its canon span. How far a run may leap hangs on its
    words so far, so the fragments of one transcript and chapter are folded as one array."""
    parts = found.groupBy(doc, item).agg(F.array_sort(F.collect_list(F.struct("doc_from", "canon_from", "doc_to", "canon_to"))).alias("f"))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        skipped, leapt = x["doc_from"] - last["doc_to"], x["canon_from"] - last["canon_to"]
        joins = (skipped >= 0) & (leapt >= 0) & (skipped <= reach) & (leapt < F.when(last["matched"] < settled, early).otherwise(reach))
        n = (x["doc_to"] - x["doc_from"]).cast("long")
        new = F.struct(x["doc_from"].alias("doc_from"), x["doc_to"].alias("doc_to"), x["canon_from"].alias("canon_from"), x["canon_to"].alias("canon_to"), n.alias("matched"))
        grown = F.struct(last["doc_from"].alias("doc_from"), x["doc_to"].alias("doc_to"), last["canon_from"].alias("canon_from"), x["canon_to"].alias("canon_to"), (last["matched"] + n).alias("matched"))
        return F.when((F.size(done) > 0) & joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(new)))

    kind = "array<struct<doc_from:int,doc_to:int,canon_from:int,canon_to:int,matched:bigint>>"
    runs = parts.select(doc, item, F.posexplode(F.aggregate("f", F.array().cast(kind), step)).alias("run", "r")).select(doc, item, "run", "r.*")
    runs = runs.withColumn("score", F.round(F.least(F.lit(1.0), F.col("matched") / (F.col("canon_to") - F.col("canon_from"))), 6))
    return runs.filter((F.col("matched") >= least) & (F.col("score") >= score))


def repeats(runs: DataFrame, found: DataFrame, doc: str, item: str, sure: float = SURE) -> DataFrame:
    """Further occurrences of the canon spans of runs that score `sure` or more, in the shape of runs: fragments inside
    the span, chained as above, that hold REPEATED of its words (AT_LEAST of them, or all of a shorter span), where runs
    have taken no more than TAKEN of the occurrence's words."""
    spans = staged(runs.filter(F.col("score") >= sure).select(doc, item, F.col("canon_from").alias("a"), F.col("canon_to").alias("b")).distinct(), "spans")
    inside = intervals.meeting(found, spans, [doc, item], ("canon_from", "canon_to"), ("a", "b"), CELL)
    cut = F.greatest(F.lit(0), F.col("a") - F.col("canon_from"))
    over = F.greatest(F.lit(0), F.col("canon_to") - F.col("b"))
    inside = inside.select(doc, F.struct(item, "a", "b").alias("span"), (F.col("doc_from") + cut).alias("doc_from"), (F.col("doc_to") - over).alias("doc_to"), (F.col("canon_from") + cut).alias("canon_from"), (F.col("canon_to") - over).alias("canon_to"))
    every = chain_runs(inside, doc, "span", least=1, score=0.0)
    length = F.col("span.b") - F.col("span.a")
    every = every.filter(F.col("matched") >= F.greatest(F.least(F.lit(AT_LEAST), length), F.ceil(length * REPEATED)))
    every = staged(every.select(doc, f"span.{item}", F.col("span.a").alias("a"), "doc_from", "doc_to", "canon_from", "canon_to", "matched", F.round(F.col("matched") / length, 6).alias("score")), "occurrences")
    taken = intervals.meeting(every, runs.select(doc, F.col("doc_from").alias("f"), F.col("doc_to").alias("t")), [doc], ("doc_from", "doc_to"), ("f", "t"), CELL)
    taken = taken.groupBy(doc, item, "a", "doc_from", "doc_to").agg(F.sum(F.least("t", "doc_to") - F.greatest("f", "doc_from")).alias("taken"))
    left = every.join(taken, [doc, item, "a", "doc_from", "doc_to"], "left").filter(F.coalesce("taken", F.lit(0)) <= TAKEN * (F.col("doc_to") - F.col("doc_from")))
    return left.drop("a", "taken")


def settle(claims: DataFrame, doc: str, item: str, shared: float = SHARED) -> DataFrame:
    """Claims (runs and repeats) without those that lose their words to another chapter.

    Two claims of different chapters are rivals where they share half of the smaller one's words. The chapter with more
    matched words in the transcript wins, then the higher score, then the lower chapter, then the earlier claim. In that order a claim stays
    unless a rival before it stays: each round keeps the claims without an open rival before them and drops their rivals."""
    total = claims.groupBy(doc, item).agg(F.sum("matched").alias("_all"))
    rank = F.struct((-F.col("_all")).alias("all"), (-F.col("score")).alias("score"), F.col(item).alias("item"), "doc_from", "doc_to", "canon_from")
    columns = claims.columns
    every = staged(claims.join(total, [doc, item]).withColumn("_rank", rank).withColumn("_claim", F.monotonically_increasing_id()), "claims")
    own = every.select(doc, item, "doc_from", "doc_to", "_rank", "_claim")
    after = own.select(doc, *(F.col(c).alias(f"_b_{c}") for c in (item, "doc_from", "doc_to", "_rank", "_claim")))
    common = F.least("doc_to", "_b_doc_to") - F.greatest("doc_from", "_b_doc_from")
    smaller = F.least(F.col("doc_to") - F.col("doc_from"), F.col("_b_doc_to") - F.col("_b_doc_from"))
    before = (F.col("_rank") < F.col("_b__rank")) & (F.col(item) != F.col(f"_b_{item}"))
    met = intervals.meeting(own, after, [doc], ("doc_from", "doc_to"), ("_b_doc_from", "_b_doc_to"), CELL)
    rivals = staged(met.filter(before & (common >= shared * smaller)).select(F.col("_claim").alias("over"), F.col("_b__claim").alias("_claim")), "rivals")
    dropped = None
    open_ = rivals
    while not open_.isEmpty():
        # claims that beat others and that nobody open beats
        kept = open_.select(F.col("over").alias("_claim")).distinct().join(open_.select("_claim").distinct(), "_claim", "left_anti")
        out = staged(open_.join(kept.withColumnRenamed("_claim", "over"), "over", "left_semi").select("_claim").distinct(), "dropped")
        dropped = out if dropped is None else dropped.unionByName(out)
        gone = open_.join(out, "_claim", "left_anti").join(out.withColumnRenamed("_claim", "over"), "over", "left_anti")
        open_ = staged(gone, "open")
    left = every if dropped is None else every.join(dropped, "_claim", "left_anti")
    return left.select(*columns)


def detect(docs: DataFrame, canon: DataFrame, doc: str = "doc_id", item: str = "item_id") -> DataFrame:
    """Runs and repeats that stay, in the shape of runs without their number; `docs` and `canon` have a `text` each, or its words in `w`.
    Every word pair that both sides have counts."""
    found = staged(fragments(docs, canon, doc, item, None), "fragments")
    runs = staged(chain_runs(found, doc, item), "runs").drop("run")
    return settle(runs.unionByName(repeats(runs, found, doc, item)), doc, item)


def covered_items(claims: DataFrame, doc: str, item: str) -> DataFrame:
    """(doc, item, matched, offset_from, offset_to): how many words of each chapter a transcript has, and between which places."""
    return claims.groupBy(doc, item).agg(F.sum("matched").alias("matched"), F.min("canon_from").alias("offset_from"), F.max("canon_to").alias("offset_to"))
