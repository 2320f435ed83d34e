"""From timed words of verses to cues: phrases with their own part of a verse's text and translation, and what is shown of them.

words (clip_id, group, idx, start_ms, end_ms, place), idx distinct in a clip and in order of time, place the word of the
group's text that each recites, or null; groups (clip_id, group, canon, translation): arrays of words, group a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ends_clause, trimmed
from . import cues
from .answers import Answer
from .ordered import few
from .translation import chunk_at, natural_chunks

GROUP = ["clip_id", "group"]
#: Words at either end of a text that are shown though nobody was heard to say them.
UNHEARD = 2
TEXTS = ("text", "translation")
#: Pieces of a segment, and words of a piece, fewer than so many.
PLACES = 1_048_576
#: Words and breaths last seconds, so they meet by cells of a minute; this changes no result.
CELL = 60_000


def phrase_texts(words: DataFrame, groups: DataFrame, silence: DataFrame | None, whole: bool | None = None) -> DataFrame:
    """(clip_id, group, phrase, first, last, start_ms, end_ms, text, translation): each group cut at breaths, its text dealt over the phrases.

    Where each phrase has a word with a place, a phrase shows its places from the lowest to the highest one, and what the phrase before it
    has left out before them; the first one begins with the text, and the last one ends with it if UNHEARD words or fewer are
    left. Else phrases show their share of the text by their words, one word at least as long as there are some, and the last one the
    rest. Of the translation each phrase has a natural piece. A group of one phrase shows all. Null or missing texts are
    empty; groups without words have no row. whole: as in cues.phrases."""
    rows = cues.phrases(words.select(*GROUP, "idx", "start_ms", "end_ms", "place"), silence, GROUP, whole, CELL)
    own = rows.groupBy(*GROUP, "phrase").agg(F.min_by("start_ms", "idx").alias("start_ms"), F.max_by("end_ms", "idx").alias("end_ms"), F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"))
    none = F.array().cast("array<string>")
    # the phrases of one verse
    verses = own.groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("phrase", "start_ms", "end_ms", "n", "low", "high"))).alias("phrases"))
    verses = verses.withColumns({"many": F.size("phrases").cast("long"), "total": F.aggregate("phrases", F.lit(0).cast("long"), lambda a, x: a + x["n"]), "known": F.forall("phrases", lambda x: x["low"].isNotNull())})
    verses = verses.join(groups.select(*GROUP, "canon", "translation"), GROUP, "left").withColumns({"canon": F.coalesce("canon", none), "translation": F.coalesce("translation", none)})
    # a group of one phrase shows all of the translation
    cut_up = lambda x: F.when(F.col("many") > 1, x)
    verses = verses.withColumn("chunks", natural_chunks(cut_up(F.col("translation")), cut_up(F.transform("phrases", lambda x: x["n"])))).withColumn("size", F.size("canon"))
    rows = verses.withColumn("x", F.explode("phrases")).select(*GROUP, "x.*", *(c for c in verses.columns if c not in (*GROUP, "phrases")))
    verse = Window.partitionBy(*GROUP).orderBy("phrase")
    upto = verse.rowsBetween(Window.unboundedPreceding, 0)
    is_last = F.col("phrase") == F.col("many") - 1
    last = F.when(is_last & (F.col("size") - 1 - F.col("high") <= UNHEARD), F.col("size")).otherwise(F.col("high") + 1)
    share = F.least(F.floor(F.col("size") * F.sum("n").over(upto) / F.col("total")), F.col("size") - (F.col("many") - F.col("phrase") - 1))
    rows = rows.withColumns({"heard": last, "share": F.when(is_last, F.col("size")).otherwise(share)})
    # a phrase has a word more than the one before it, if there is one left
    dealt = F.least(F.col("size"), F.greatest(F.col("phrase") + 1, F.max(F.col("share") - F.col("phrase")).over(upto) + F.col("phrase")))
    rows = rows.withColumn("dealt", dealt)
    by_place = F.col("known") & (F.col("size") > 0)
    alone = F.col("many") == 1
    head = F.when((F.col("phrase") == 0) & (F.col("low") <= UNHEARD), 0).otherwise(F.col("low"))
    bounds = {
        "first": F.when(alone, 0).when(by_place, F.least(head, F.coalesce(F.lag("heard").over(verse), F.lit(0)))).otherwise(F.coalesce(F.lag("dealt").over(verse), F.lit(0))).cast("int"),
        "last": F.when(alone, F.col("size")).when(by_place, F.col("heard")).otherwise(F.col("dealt")).cast("int"),
    }
    rows = rows.withColumns(bounds).withColumn("piece", chunk_at(F.col("chunks"), F.col("phrase"), F.col("many")))
    cut = lambda w, a, b: F.array_join(F.slice(w, a + 1, F.greatest(F.lit(0), b - a)), " ")
    other = F.when(alone, F.array_join("translation", " ")).otherwise(F.coalesce(cut(F.col("translation"), F.col("piece.first"), F.col("piece.last")), F.lit("")))
    return rows.select(*GROUP, "phrase", "first", "last", "start_ms", "end_ms", cut(F.col("canon"), F.col("first"), F.col("last")).alias("text"), other.alias("translation"))


def word_time_cues(words: DataFrame, verses: DataFrame, offsets: DataFrame, openings: dict[int, tuple[int, str, str]], silence: DataFrame | None) -> DataFrame:
    """(clip_id, start_ms, end_ms, text, translation): what is shown of aligned words (clip_id, idx, verse, start_ms, end_ms).

    All words of a clip with one tag are a group. A tag of `openings` (tag -> verse that it is shown as, words, translation) is
    an opening phrase, any other one a verse of `verses` (verse, canon, translation). offsets (clip_id, verse, first, last): the words of
    a verse that the clip has, of which no more are shown than were heard, counted from the first. In this order: group,
    trim, cut at breaths, show."""
    whole = few(words, ["clip_id", "verse"])
    known = openings.items()
    of = lambda value, other: F.coalesce(*(F.when(F.col("group") == tag, F.lit(value(o))) for tag, o in known), other) if known else other
    rows = words.dropna(subset=["clip_id", "verse", "start_ms", "end_ms"]).withColumnRenamed("verse", "group").withColumn("place", F.lit(None).cast("int"))
    groups = rows.groupBy(*GROUP).agg(F.count("*").alias("n")).withColumn("verse", of(lambda o: o[0], F.col("group")))
    # dealt as the words are, before texts are added
    placed = groups.join(offsets.select("clip_id", "verse", "first", "last"), ["clip_id", "verse"], "left").repartition(*GROUP)
    listed = verses.select(F.col("verse").alias("group"), "canon", "translation", F.transform(F.coalesce("translation", F.array().cast("array<string>")), ends_clause).alias("ends"))
    texts = placed.join(listed, "group", "left")
    none = F.array().cast("array<string>")
    words_of: Column = F.coalesce(of(lambda o: o[1].split(), F.lit(None).cast("array<string>")), "canon", none)
    meant: Column = F.coalesce(of(lambda o: o[2].split(), F.lit(None).cast("array<string>")), "translation", none)
    ends: Column = F.coalesce(of(lambda o: o[2].split(), F.lit(None).cast("array<string>")), none)
    ends = F.when(F.col("group").isin(*openings), F.transform(ends, ends_clause)).otherwise(F.coalesce("ends", none.cast("array<boolean>"))) if openings else F.coalesce("ends", none.cast("array<boolean>"))
    texts = texts.withColumns({"canon": words_of, "translation": meant, "ends": ends})
    end = F.least("last", F.col("first") + F.col("n"))
    part = trimmed(F.col("canon"), F.col("translation"), F.col("first").cast("int"), end.cast("int"), F.col("ends"))
    texts = texts.withColumn("t", F.when(F.col("first").isNotNull() & (F.size("canon") > 0), part))
    split = lambda t, w: F.when(F.col("t").isNull(), F.col(w)).otherwise(F.filter(F.split(f"t.{t}", " "), lambda x: x != ""))
    texts = texts.select(*GROUP, split("own", "canon").alias("canon"), split("other", "translation").alias("translation"))
    found = phrase_texts(rows, texts, silence, whole)
    return cues.show(found, (rows.limit(0) if silence is None else silence).select("clip_id", "start_ms", "end_ms"), TEXTS, CELL)


def answer_cues(answer: Answer, silence: DataFrame) -> DataFrame:
    """(clip_id, start_ms, end_ms, text, translation): what is shown of an aligner's answer.

    In this order: pieces are cut at breaths, a phrase ends where a breath inside it begins, and what is left is led in and out
    and kept apart. Only silence of a breath's length (NEAR_RUN) blanks a cue."""
    group = (F.col("seg") * PLACES + F.col("piece")).alias("group")
    # the words of one piece, which begins at their lowest place
    piece = Window.partitionBy(*GROUP)
    words = answer.words.select("clip_id", group, "w", "start_ms", "end_ms", "place")
    nth = F.row_number().over(piece.orderBy("start_ms", "w"))
    rows = words.select(*GROUP, (F.col("group") * PLACES + nth).alias("idx"), "start_ms", "end_ms", (F.col("place") - F.min("place").over(piece)).alias("place"))
    texts = answer.pieces.select("*", group).select(*GROUP, *(F.filter(F.split(F.coalesce(t, F.lit("")), " "), lambda x: x != "").alias(n) for t, n in (("text", "canon"), ("translation", "translation"))))
    found = cues.numbered(phrase_texts(rows, texts, silence, few(words, GROUP)).select("clip_id", "start_ms", "end_ms", *(F.coalesce(t, F.lit("")).alias(t) for t in TEXTS)))
    breaths = silence.filter(F.col("end_ms") - F.col("start_ms") >= cues.NEAR_RUN)
    whole = few(found, ["clip_id"])
    times = cues.trimmed(found.select(*cues.TIMES), breaths, ["clip_id"] if whole else None, CELL)
    return cues.shown(times, found, breaths, TEXTS, whole, CELL)
