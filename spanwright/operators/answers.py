"""An aligner's answer as pieces of verses: its segments with word references, opening phrases as segments of a kind of their own.

segments (clip_id, seg, kind, special, from_ms), words (clip_id, seg, w, location, start_ms, end_ms) with times from the segment's
start, w distinct in a segment and segments in order of seg; verses (chapter, verse, canon, translation), arrays of words."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ends_clause, fold, reference, trimmed
from ..sources.shared import staged


class Opening(NamedTuple):
    """An opening phrase: the verse that it counts as, its words as shown, and its translation. `special` is what the aligner's
    kinds hold, `prefixes` the places that its words refer to; without either the phrase is looked for in a clip's first piece."""

    name: str
    chapter: int
    verse: int
    shown: str
    translation: str
    special: str | None = None
    prefixes: tuple[str, ...] = ()


class Answer(NamedTuple):
    pieces: DataFrame
    words: DataFrame
    problems: DataFrame


#: Words of the first phrase where two stand in one segment without references, and words from which such a segment has two.
FIRST_WORDS, BOTH_WORDS = 5, 9


def _segment_words(segments: DataFrame, words: DataFrame, verses: DataFrame, first: Opening, second: Opening) -> DataFrame:
    """Each word with its verse and place, the phrase that it belongs to, and what is wrong with it."""
    kind = segments.select("clip_id", "seg", F.lower(F.trim(F.coalesce("kind", F.lit("")))).alias("kind"), F.lower(F.coalesce("special", F.lit(""))).alias("special"), F.coalesce("from_ms", F.lit(0)).alias("from_ms"))
    rows = words.select("clip_id", "seg", "w", "location", "start_ms", "end_ms").join(kind, ["clip_id", "seg"])
    rows = rows.withColumn("is_special", F.col("kind") == "special")
    # the words of one segment, which a breath ends
    whole = Window.partitionBy("clip_id", "seg")
    prefix = F.coalesce(F.substring_index("location", ":", 2), F.lit(""))
    of_first, of_second = prefix.isin(*first.prefixes), prefix.isin(*second.prefixes)
    rows = rows.withColumns({
        "of_first": of_first,
        "has_first": F.col("special").contains(first.special) | F.max(of_first).over(whole),
        "has_second": F.col("special").contains(second.special) | F.max(of_second).over(whole),
        "n": F.count("*").over(whole),
        "n_first": F.count_if(of_first).over(whole),
        "nth": F.row_number().over(whole.orderBy("w")),
    })
    told = (F.col("n_first") > 0) & (F.col("n_first") < F.col("n"))
    cut = F.when(F.col("n") >= BOTH_WORDS, FIRST_WORDS).otherwise(0)
    both = F.when(F.when(told, F.col("of_first")).otherwise(F.col("nth") <= cut), first.name).otherwise(second.name)
    phrase = F.when(F.col("has_first") & F.col("has_second"), both).when(F.col("has_first"), first.name).when(F.col("has_second"), second.name)
    rows = rows.withColumn("phrase", F.when(F.col("is_special"), phrase)).withColumn("at", F.when(~F.col("is_special"), reference(F.col("location"))))
    rows = rows.withColumns({"chapter": F.get("at", F.lit(0)), "verse": F.get("at", F.lit(1)), "place": F.get("at", F.lit(2)) - 1})
    rows = rows.join(verses.select("chapter", "verse", F.col("canon").alias("_canon")), ["chapter", "verse"], "left")
    inside = (F.col("place") >= 0) & (F.col("place") < F.coalesce(F.size("_canon"), F.lit(0)))
    problem = (
        F.when(F.col("is_special") & F.col("phrase").isNull(), "special")
        .when(~F.col("is_special") & F.col("at").isNull(), "location")
        .when(~F.col("is_special") & (F.col("chapter") < 1), "chapter")
        .when(~F.col("is_special") & ~F.coalesce(inside, F.lit(False)), "numbering")
        .when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "timing")
    )
    start = F.col("from_ms") + F.col("start_ms")
    timed = {"start_ms": start, "end_ms": F.greatest(start, F.col("from_ms") + F.col("end_ms")), "text": F.get("_canon", F.col("place")), "problem": problem}
    return rows.withColumns(timed).select("clip_id", "seg", "w", "is_special", "phrase", "chapter", "verse", "place", "text", "start_ms", "end_ms", "problem")


def read_answer(segments: DataFrame, words: DataFrame, verses: DataFrame, openings: list[Opening]) -> Answer:
    """pieces (clip_id, seg, piece, name, chapter, verse, first, last, start_ms, end_ms, text, translation), words (clip_id, seg,
    piece, w, place, text, start_ms, end_ms), problems (clip_id, problem).

    In a segment words go by their start; a piece is a stretch of them that refers to one verse, so a repeat is a piece of its
    own. A special segment is the first two of `openings`, or one of them; its words show the phrase's. A clip's first piece
    whose words are exactly another opening (one without `special`), or the first of the two, counts as that. A clip with a word that can't be
    trusted (reference, numbering, time, unknown phrase; the first of them by segment and word), or without any word, is a
    problem and has no pieces. Words of segments that are not listed are left out."""
    first, second = openings[:2]
    known = staged(_segment_words(segments, words, verses, first, second), "answer")
    problems = known.filter("problem is not null").groupBy("clip_id").agg(F.min_by("problem", F.struct("seg", "w")).alias("problem"))
    empty = segments.select("clip_id").distinct().join(known.select("clip_id").distinct(), "clip_id", "left_anti").select("clip_id", F.lit("empty").alias("problem"))
    problems = staged(problems.unionByName(empty).filter("clip_id is not null"), "problems")
    rows = known.join(problems, "clip_id", "left_anti").drop("problem")
    order = ["start_ms", "w"]
    segment = Window.partitionBy("clip_id", "seg").orderBy(*order)
    verse = F.struct("chapter", "verse")
    opens = F.coalesce((F.lag(verse).over(segment) != verse).cast("int"), F.lit(0))
    rows = rows.withColumn("_opens", opens)
    piece = F.when(F.col("is_special"), (F.col("phrase") == second.name).cast("long")).otherwise(F.sum("_opens").over(segment))
    rows = rows.withColumn("piece", piece)
    nth = F.row_number().over(Window.partitionBy("clip_id", "seg", "piece").orderBy(*order)) - 1
    rows = rows.withColumn("place", F.when(F.col("is_special"), nth).otherwise(F.col("place")))
    shown = lambda o: F.array(*map(F.lit, o.shown.split()))
    said = F.when(F.col("phrase") == first.name, F.get(shown(first), F.col("place"))).when(F.col("phrase") == second.name, F.get(shown(second), F.col("place")))
    rows = staged(rows.withColumn("text", F.when(F.col("is_special"), F.coalesce(said, F.lit(""))).otherwise(F.col("text"))).drop("_opens"), "pieces")
    key = ["clip_id", "seg", "piece"]
    # a piece's words share these
    of_piece = [*key, F.col("phrase").alias("name"), "chapter", "verse"]
    found = rows.groupBy(*of_piece).agg(F.min("place").alias("first"), (F.max("place") + 1).alias("last"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    # only a clip's first piece is compared with openings
    begin = rows.groupBy("clip_id").agg(F.min(F.struct("start_ms", "seg", "piece")).alias("x")).select("clip_id", "x.seg", "x.piece")
    forms = F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: fold(x["text"]))
    begun = rows.join(begin, key).groupBy(*of_piece).agg(F.min("place").alias("_first"), forms.alias("forms"))
    retagged = F.lit(None).cast("string")
    for o in reversed([o for o in openings if o is not second]):
        same = F.col("forms") == F.transform(shown(o), fold)
        retagged = F.when(F.col("name").isNull() & (F.col("verse") > 0) & same, o.name).otherwise(retagged)
    moved = staged(begun.select(*key, retagged.alias("_as"), "_first").filter("_as is not null"), "retagged")
    found = found.join(moved.select(*key, F.col("_as").alias("retagged")), key, "left")
    name = F.coalesce("retagged", "name")
    of = lambda value: F.coalesce(*(F.when(name == o.name, F.lit(value(o))) for o in openings))
    other = F.coalesce("translation", F.array().cast("array<string>"))
    known = verses.select("chapter", "verse", "canon", other.alias("translation"), F.transform(other, ends_clause).alias("ends"))
    pieces = found.join(known, ["chapter", "verse"], "left").withColumn("t", trimmed(F.col("canon"), F.coalesce("translation", F.array().cast("array<string>")), F.col("first"), F.col("last"), F.col("ends")))
    columns: dict[str, Column] = {
        "name": name,
        "chapter": F.coalesce(of(lambda o: o.chapter), "chapter"),
        "verse": F.coalesce(of(lambda o: o.verse), "verse"),
        "first": F.when(F.col("retagged").isNotNull(), 0).otherwise(F.col("first")),
        "last": F.when(F.col("retagged").isNotNull(), F.col("last") - F.col("first")).otherwise(F.col("last")),
        "start_ms": F.col("start_ms"),
        "end_ms": F.col("end_ms"),
        "text": F.coalesce(of(lambda o: o.shown), "t.own"),
        "translation": F.coalesce(of(lambda o: o.translation), "t.other"),
    }
    pieces = pieces.select(*key, *(c.alias(n) for n, c in columns.items()))
    spoken = F.coalesce(*(F.when(F.col("_as") == o.name, F.get(shown(o), F.col("place"))) for o in openings), F.col("text"))
    out = rows.join(moved, key, "left").withColumn("place", F.col("place") - F.coalesce("_first", F.lit(0)))
    return Answer(pieces, out.select(*key, "w", "place", spoken.alias("text"), "start_ms", "end_ms"), problems)
