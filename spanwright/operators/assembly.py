"""From aligned words to captions: places in the canon, word cues, holes, openings, and decoding of frames and tokens.

Words are (clip_id, idx, start_ms, end_ms, ...), idx distinct in a clip, times in integer milliseconds."""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.text import fold, fold_standard, lists, word_forms
from ..sources.shared import staged
from . import intervals
from .ordered import Over, over_others
from .search import ratios

#: How near a place has to be to the expected one, and how alike (of 100), for a word that was misheard.
NEARBY, ALIKE = 10, 78
#: Tolerance of group and hole edges.
EDGE = 50
PLACES = 65_536


@lru_cache(1 << 16)
def _letters(word: str) -> int:
    """A bit for each letter's first, second, ... time in a word: words share no more letters than their bits tell."""
    seen = 0
    for c in word:
        bit = 1 << ord(c) % 32
        while seen & bit:
            bit <<= 32
        seen |= bit
    return seen


def _most_alike(word: str, near: list[list[str]]) -> int | None:
    """The first place of those whose spellings the word is most ALIKE to; spellings that share too few letters are passed over."""
    n, own, some = len(word), _letters(word), []
    for k, forms in enumerate(near):
        for f in forms:
            if f and 200 * (own & _letters(f)).bit_count() >= ALIKE * (n + len(f)):
                some.append((k, f))
    if not some:
        return None
    top, k = max((s, -k) for s, (k, _) in zip(ratios(word, [f for _, f in some]), some, strict=True))
    return -k if top >= ALIKE else None


@F.arrow_udf(ArrayType(IntegerType()))
def recited(heard: pa.Array, canon: pa.Array, plain: pa.Array) -> pa.Array:
    """For each heard word the canon place that it recites, or null: `canon_places`. canon has all spellings of each canon word, plain
    those that a misheard word is compared with. A word is looked up, and a misheard one meets the places nearby alone."""
    out = []
    for words, every, spelled in zip(lists(heard), lists(canon), lists(plain), strict=True):
        places: dict[str, list[int]] = {}
        for j, own in enumerate(every):
            for form in own:
                places.setdefault(form, []).append(j)
        pos, found = 0, []
        for w in words:
            place = None
            if w and w in places:
                at = places[w]
                k = bisect_left(at, pos)
                place = at[k] if k < len(at) and (k == 0 or at[k] - pos <= pos - at[k - 1]) else at[k - 1]
            elif w:
                low = max(0, pos - NEARBY)
                place = _most_alike(w, spelled[low : pos + NEARBY])
                place = None if place is None else low + place
            pos = pos if place is None else place + 1
            found.append(place)
        out.append(found)
    return pa.array(out, pa.list_(pa.int32()))


def canon_places(words: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """words (keys, idx, word) with `place`, the word of the keys' text (array of raw words `canon`) that each recites, or null.

    The expected place is the one behind the last found. Of equal words the nearest to it counts, of two as near the later one; a
    word that is nowhere takes the most alike place up to NEARBY away (the first of equally alike). What is expected hangs on the
    words before, so one passage's words are gone through as one array; keys name a passage."""
    parts = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", fold(F.coalesce("word", F.lit(""))).alias("w")))).alias("own")).join(texts.select(*keys, "canon"), keys, "left")
    canon = F.coalesce("canon", F.array().cast("array<string>"))
    plain = F.transform(canon, lambda c: F.array(fold(c), fold_standard(c)))
    parts = parts.withColumn("place", recited(F.transform("own", lambda x: x["w"]), F.transform(canon, word_forms), plain))
    each = F.zip_with("own", "place", lambda x, place: F.struct(x["idx"].alias("idx"), place.alias("place")))
    found = parts.select(*keys, F.explode(each).alias("x")).select(*keys, "x.idx", "x.place")
    return words.join(found, [*keys, "idx"], "left")


def word_cues(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(clip_id, phrase, cue, start_ms, end_ms, text): the phrase's text dealt over its cues.

    words (clip_id, phrase, idx, start_ms, end_ms, place, cue), texts (clip_id, phrase, start_ms, end_ms, canon array). A cue
    begins at its lowest place, but each cue has a word at least, so cue k begins at k plus the most that the lowest place of
    any cue up to it is past its number, and that is at most the words less the cues. Cues past the words join the last. The
    first cue keeps the phrase's start, if that is earlier, and the last its end."""
    sized = texts.select("clip_id", "phrase", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), "canon", F.size("canon").alias("_n")).filter("_n > 0")
    rows = words.join(sized, ["clip_id", "phrase"]).withColumn("cue", F.least("cue", F.col("_n") - 1))
    own = rows.groupBy("clip_id", "phrase", "cue").agg(F.min_by("start_ms", "idx").alias("start_ms"), F.max_by("end_ms", "idx").alias("end_ms"), F.min("place").alias("low"), *(F.first(c).alias(c) for c in ("_s", "_e", "canon", "_n")))
    # the cues of one phrase
    phrase = Window.partitionBy("clip_id", "phrase")
    upto = phrase.orderBy("cue").rowsBetween(Window.unboundedPreceding, 0)
    past = F.greatest(F.lit(0), F.max(F.when(F.col("cue") > 0, F.col("low") - F.col("cue"))).over(upto))
    own = own.withColumn("_many", F.count("*").over(phrase)).withColumn("_from", F.when(F.col("cue") == 0, 0).otherwise(F.col("cue") + F.least(F.col("_n") - F.col("_many"), past)).cast("int"))
    to = F.coalesce(F.lead("_from").over(phrase.orderBy("cue")), "_n")
    start = F.when(F.col("cue") == 0, F.least("start_ms", "_s")).otherwise(F.col("start_ms"))
    end = F.when(F.col("cue") == F.col("_many") - 1, F.col("_e")).otherwise(F.col("end_ms"))
    return own.withColumn("_to", to).select("clip_id", "phrase", "cue", start.alias("start_ms"), end.alias("end_ms"), F.array_join(F.slice("canon", F.col("_from") + 1, F.col("_to") - F.col("_from")), " ").alias("text"))


def close_holes(words: DataFrame, groups: DataFrame, forms: DataFrame) -> DataFrame:
    """(clip_id, idx, group) for words without a group that lie inside a group, or in a hole between two.

    words (clip_id, idx, start_ms, end_ms, word), groups (clip_id, group, start_ms, end_ms) in order of group, forms (clip_id,
    group, word): all words of each group's text. Inside: the first group, widened by EDGE, that holds the word. In a hole over
    EDGE the words go together to the group that has more of them (repeats counted, the later one of equal ones), if
    that is half of them or more, else to the earlier one."""
    rows = staged(words.select("clip_id", "idx", "start_ms", "end_ms", "word"), "loose")
    wide = groups.select("clip_id", (F.col("start_ms") - EDGE).alias("start_ms"), (F.col("end_ms") + EDGE).alias("end_ms"), "group")
    back = wide.select("clip_id", F.col("start_ms").alias("other_start_ms"), F.col("end_ms").alias("other_end_ms"), "group")
    held = intervals.overlaps(rows, wide, ["clip_id"], -1).filter("start_ms >= other_start_ms and end_ms <= other_end_ms").join(back, ["clip_id", "other_start_ms", "other_end_ms"])
    inside = staged(held.groupBy("clip_id", "idx").agg(F.min("group").alias("group")), "inside")
    after = over_others(groups.select("clip_id", "group", "start_ms", "end_ms"), ["clip_id"], ["group"], F.floor(F.col("group") / PLACES), Over("_next", "min", F.struct("group", "start_ms"), later=True))
    holes = after.filter(F.col("_next.start_ms") - F.col("end_ms") > EDGE).select("clip_id", "group", F.col("_next.group").alias("then"), (F.col("end_ms") - EDGE).alias("start_ms"), (F.col("_next.start_ms") + EDGE - 1).alias("end_ms"))
    holes = staged(holes, "holes")
    back = holes.select("clip_id", F.col("start_ms").alias("other_start_ms"), F.col("end_ms").alias("other_end_ms"), "group", "then")
    left = rows.join(inside, ["clip_id", "idx"], "left_anti")
    begun = left.select("clip_id", "idx", "word", "start_ms", F.col("start_ms").alias("end_ms"))
    lost = intervals.overlaps(begun, holes, ["clip_id"], -1).join(back, ["clip_id", "other_start_ms", "other_end_ms"])
    lost = staged(lost.groupBy("clip_id", "idx").agg(F.min(F.struct("group", "then")).alias("h"), F.first("word").alias("word")).select("clip_id", "idx", "h.*", "word"), "lost")
    known = forms.select("clip_id", F.col("group").alias("_of"), "word").distinct()

    def hits(side: str) -> DataFrame:
        got = lost.join(known.withColumnRenamed("_of", side), ["clip_id", side, "word"], "left_semi")
        return got.groupBy("clip_id", "group").agg(F.count("*").alias(f"n_{side}"))

    own = lost.filter("word <> ''").groupBy("clip_id", "group", "then").agg(F.count("*").alias("n")).join(hits("group"), ["clip_id", "group"], "left").join(hits("then"), ["clip_id", "group"], "left")
    a, b = F.coalesce("n_group", F.lit(0)), F.coalesce("n_then", F.lit(0))
    to = F.when((b >= a) & (2 * b >= F.col("n")) & (b > 0), F.col("then")).otherwise(F.col("group"))
    filled = lost.join(own.select("clip_id", "group", to.alias("_to")), ["clip_id", "group"]).select("clip_id", "idx", F.col("_to").alias("group"))
    return inside.unionByName(filled)


def phrase_places(words: DataFrame, phrases: dict[str, list[str]]) -> DataFrame:
    """(clip_id, name, idx, last_idx): every place where a phrase stands word by word; words (clip_id, idx, word) folded on either side.

    Each word meets the phrases' few words, and a place counts if as many met there as the phrase has."""
    spark = words.sparkSession
    own = [(n, k, len(p), w) for n, p in phrases.items() for k, w in enumerate(p)]
    listed = spark.createDataFrame(own, "name string, k long, n long, raw string")
    listed = listed.select("name", "k", "n", F.explode(F.array_distinct(F.array(fold(F.col("raw")), fold_standard(F.col("raw"))))).alias("form"))
    # as many rows as the phrases have words, twice at most
    hits = words.withColumn("form", fold(F.coalesce("word", F.lit("")))).join(F.broadcast(listed), "form").select("clip_id", "name", "n", (F.col("idx") - F.col("k")).alias("idx"), "k").distinct()
    found = hits.groupBy("clip_id", "name", "n", "idx").agg(F.count("*").alias("met")).filter("met = n")
    return found.select("clip_id", "name", "idx", (F.col("idx") + F.col("n") - 1).alias("last_idx"))


def tagged_with_next(openings: DataFrame, matches: DataFrame) -> DataFrame:
    """openings (clip_id, idx, ...) with `chapter`: that of the first match (clip_id, first_idx, chapter) that begins behind it,
    else that of the clip's first match."""
    marks = matches.select("clip_id", (F.col("first_idx") - 1).alias("_t"), F.struct("first_idx", "chapter").alias("_run"))
    points = openings.withColumn("t_ms", F.col("idx"))
    after = intervals._latest(points, marks, ["clip_id"], PLACES, later=True)
    first = matches.groupBy("clip_id").agg(F.min_by("chapter", F.struct("first_idx", "chapter")).alias("_first"))
    return after.join(first, "clip_id", "left").withColumn("chapter", F.coalesce("_run.chapter", "_first")).drop("t_ms", "_run", "_first")


def greedy_letters(frames: DataFrame, blank: str) -> DataFrame:
    """(clip_id, letters): the likeliest symbol of each frame (clip_id, frame, symbol, p), the lowest of equal ones, repeats in a row
    once, blanks left out. The letters of a clip are few next to its frames."""
    best = frames.groupBy("clip_id", "frame").agg(F.min_by("symbol", F.struct((-F.col("p")).alias("p"), "symbol")).alias("symbol"))
    rows = over_others(best, ["clip_id"], ["frame"], F.floor(F.col("frame") / PLACES), Over("_before", "max", F.struct("frame", "symbol")))
    kept = rows.filter(F.coalesce(F.col("_before.symbol") != F.col("symbol"), F.lit(True)) & (F.col("symbol") != blank))
    letters = kept.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("frame", "symbol"))).alias("x"))
    return letters.select("clip_id", F.array_join(F.transform("x", lambda x: x["symbol"]), "").alias("letters"))


def timed_tokens(tokens: DataFrame, first_time: int, step_ms: int = 20, trail_ms: int = 500) -> DataFrame:
    """(clip_id, start_ms, end_ms, first_idx, n): stretches of text tokens between time tokens; tokens (clip_id, idx, token).

    A token from first_time on is a time, step_ms each. Text before any time stays out; text behind the last one ends trail_ms after it."""
    is_time = F.col("token") >= first_time
    time = F.when(is_time, F.struct("idx", ((F.col("token") - first_time) * step_ms).cast("long").alias("ms")))
    rows = over_others(tokens, ["clip_id"], ["idx"], F.floor(F.col("idx") / PLACES), Over("_from", "max", time), Over("_to", "min", time, later=True))
    spans = rows.filter(~is_time & F.col("_from").isNotNull()).groupBy("clip_id", F.col("_from.idx").alias("at")).agg(F.first("_from.ms").alias("start_ms"), F.first("_to.ms").alias("_end"), F.min("idx").alias("first_idx"), F.count("*").alias("n"))
    return spans.select("clip_id", "start_ms", F.coalesce("_end", F.col("start_ms") + trail_ms).alias("end_ms"), "first_idx", "n")
