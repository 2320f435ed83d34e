"""Windows of whole canon entries that a short transcript is, or nearly is: a similarity join by filter and verification.

Similarity is that of insertions and deletions: 2 m / (a + b) for texts of a and b characters with m in common. A share of
it leaves at most a + b - 2 m characters beside the common ones, so of a text's stretches of q characters a known number is
in the other text. All but so many less one of them, the rarest first, are looked up: a pair above the share has one of
those in common, and no pair is lost. Only pairs that meet so are compared."""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import words
from ..sources.shared import staged
from .ordered import Over, over_others
from .search import fuzzy_ratio, ratios

#: The similarity of a whole transcript with a window of as many words, of a part with a window of SIZES words, in percent.
WHOLE, PART = 75.0, 90.0
SIZES = [12, 8, 5, 3, 2, 1]


def entry_windows(entries: DataFrame, order: str, counts: DataFrame) -> DataFrame:
    """(n, first, last, window): the runs of consecutive entries that have n words in all, for each n of `counts` (n).

    `order` is a number, unique for an entry; entries without words take no part. Prefix sums of words meet in bins as
    wide as the largest n, so an entry meets those within that many words alone."""
    own = entries.select(order, words(F.col("text")).alias("w")).filter(F.size("w") > 0).select(order, F.array_join("w", " ").alias("own"), F.size("w").cast("long").alias("size"), F.lit(0).alias("all"))
    placed = over_others(own, ["all"], [order], F.floor(F.col(order) / 4096), Over("before", "sum", F.col("size")), Over("rank", "sum", F.lit(1).cast("long")))
    placed = staged(placed.select(order, "own", "size", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("rank", F.lit(0)).alias("rank")), "entries")
    wide = counts.agg(F.max("n")).first()[0] or 1
    starts = placed.select(F.col(order).alias("first"), "before", F.col("rank").alias("a"), F.floor(F.col("before") / wide).alias("bin"))
    upto = F.col("before") + F.col("size")
    ends = placed.select(F.col(order).alias("last"), upto.alias("upto"), F.col("rank").alias("b"), F.explode(F.array(F.floor(upto / wide) - 1, F.floor(upto / wide))).alias("bin"))
    found = starts.join(ends, "bin").withColumn("n", F.col("upto") - F.col("before")).filter((F.col("n") > 0) & (F.col("n") <= wide)).join(counts.select("n").distinct(), "n", "left_semi")
    found = staged(found.select("n", "first", "last", "a", "b"), "windows")
    parts = found.select("n", "first", "last", F.explode(F.sequence("a", "b")).alias("rank")).join(placed.select("rank", "own"), "rank")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "own"))), lambda x: x["own"]), " ")
    return parts.groupBy("n", "first", "last").agg(text.alias("window"))


def _grams(text: Column, q: Column | int) -> Column:
    size = F.length(text)
    return F.when(size >= q, F.transform(F.sequence(F.lit(1), size - q + 1), lambda k: F.substring(text, k, q))).otherwise(F.array().cast("array<string>"))


def sharing_pairs(short: DataFrame, long: DataFrame, keys: list[str], q: Column, needed: Column) -> DataFrame:
    """(a, text, keys) and (b, text, keys) -> (a, b): pairs of equal keys that may be alike, as at least `needed` stretches
    of `q` (1 to 3) characters of a's text stand in b's. Stretches of `short` are looked up from the rarest on."""
    sizes = F.explode(F.array(*map(F.lit, (1, 2, 3))))
    theirs = long.select("b", "text", *keys, sizes.alias("q")).select("b", *keys, "q", F.explode(F.array_distinct(_grams(F.col("text"), F.col("q")))).alias("gram"))
    theirs = staged(theirs, "grams")
    often = theirs.groupBy(*keys, "q", "gram").agg(F.count("*").alias("often"))
    own = short.withColumn("q", q).withColumn("needed", F.greatest(F.lit(1), needed)).withColumn("grams", _grams(F.col("text"), F.col("q")))
    own = own.select("a", *keys, "q", (F.size("grams") - F.col("needed") + 1).alias("some"), F.posexplode("grams").alias("at", "gram")).join(often, [*keys, "q", "gram"], "left")
    rank = F.row_number().over(Window.partitionBy("a", *keys).orderBy(F.coalesce("often", F.lit(0)), "gram", "at"))
    looked = own.withColumn("rank", rank).filter((F.col("rank") <= F.col("some")) & F.col("often").isNotNull()).select("a", *keys, "q", "gram").distinct()
    return looked.join(theirs, [*keys, "q", "gram"]).select("a", "b").distinct()


def whole_pairs(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """(a, text, n) and (b, text, n) -> (a, b, score): pairs of as many words whose texts are WHOLE percent alike or more.

    So alike, the shorter has 0.6 of the longer's characters at least. Of a characters 0.6 a are common, and of pairs of
    neighbours 3 m - 1 - (a + b) >= 0.2 a - 1 are, which is 1 from a = 10 on."""
    a, b = F.length("text"), F.length("other")
    near = sharing_pairs(texts, windows, ["n"], F.when(a < 10, 1).otherwise(2), F.when(a < 10, F.ceil(a * 0.6 - 1e-9)).otherwise(F.ceil(a * 0.2 - 1 - 1e-9)))
    pairs = near.join(texts.select("a", "text"), "a").join(windows.select("b", F.col("text").alias("other")), "b").filter(5 * F.least(a, b) >= 3 * F.greatest(a, b))
    return pairs.select("a", "b", fuzzy_ratio("text", "other").alias("score")).filter(F.col("score") >= WHOLE)


def part_score(short: str, long: str) -> float:
    """The similarity of `short` with the most similar stretch of `long` that is as long, or shorter at either end, if it is
    PART percent or more, else 0. Only stretches with as many stretches of q characters in common as part_pairs says are compared."""
    n = len(short)
    if short in long:
        return 100.0
    if n < 6:
        return 0.0  # one character less is under 90 percent
    q, needed = (3, max(1, -int(-(n * 0.4545 - 2) // 1))) if n >= 7 else (2, 3)
    own = {short[k : k + q] for k in range(n - q + 1)}
    hits = [0, *accumulate(long[k : k + q] in own for k in range(len(long) - q + 1))]
    near = (k for k in range(1 - n, len(long)) if hits[max(0, min(k + n - q + 1, len(hits) - 1))] - hits[min(max(0, k), len(hits) - 1)] >= needed)
    best = max(ratios(short, (long[max(0, k) : k + n] for k in near)), default=0.0)
    return best if best >= PART else 0.0


@F.pandas_udf(DoubleType())
def _part_scores(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([part_score(*sorted(x, key=len)) for x in zip(a, b, strict=True)], dtype="float64")


def part_pairs(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """(a, text) and (b, text) -> (a, b, score): pairs where the shorter text is PART percent like a stretch of the longer.

    Such a stretch has 0.818 of the s characters of the shorter at least. Of its stretches of three characters
    5 m - 2 - 2 (s + w) >= 0.4545 s - 2 are common, which is 1 from s = 7 on; of those of two, 0.636 s - 1."""
    s = F.length("text")
    q = F.when(s >= 7, 3).otherwise(F.least(F.lit(2), s))
    needed = F.when(s >= 7, F.ceil(s * 0.4545 - 2)).when(s >= 2, F.ceil(s * 0.636 - 1)).otherwise(1)
    turned = lambda df, to: df.select(F.col(df.columns[0]).alias(to), "text")
    texts, windows = texts.select("a", "text").filter("text <> ''"), windows.select("b", "text").filter("text <> ''")
    near = sharing_pairs(texts, windows, [], q, needed)
    other = sharing_pairs(turned(windows, "a"), turned(texts, "b"), [], q, needed).select(F.col("b").alias("a"), F.col("a").alias("b"))
    pairs = near.withColumn("own", F.lit(True)).unionByName(other.withColumn("own", F.lit(False))).join(texts, "a").join(windows.select("b", F.col("text").alias("other")), "b")
    # each pair comes from its shorter text; of equal lengths either will do
    pairs = pairs.filter(F.when(F.col("own"), s <= F.length("other")).otherwise(F.length("other") < s))
    shorter, longer = F.when(s <= F.length("other"), F.col("text")).otherwise(F.col("other")), F.when(s <= F.length("other"), F.col("other")).otherwise(F.col("text"))
    # what a stretch has in common the whole text has
    pairs = pairs.withColumn("short", shorter).withColumn("long", longer).withColumn("n", F.length("short"))
    many = F.size(F.filter(_grams(F.col("short"), F.when(F.col("n") >= 7, 3).otherwise(F.least(F.lit(2), F.col("n")))), lambda g: F.col("long").contains(g)))
    pairs = pairs.filter(F.when(F.col("n") < 6, F.col("long").contains(F.col("short"))).when(F.col("n") < 7, many >= 3).otherwise(many >= F.ceil(F.col("n") * 0.4545 - 2)))
    return pairs.select("a", "b", _part_scores("short", "long").alias("score")).filter(F.col("score") >= PART)


def tight_windows(transcripts: DataFrame, entries: DataFrame, key: str, order: str) -> DataFrame:
    """(key, text) and (order, text) -> (key, words, first, last, score): the window of entries that each transcript is.

    Of windows with as many words as the transcript the most similar one, if it is WHOLE percent alike; or else of windows
    with 12 words the best, if it and the transcript are alike in PART percent, or else of those with 8, and so on through
    SIZES (`words` tells which). Ties: the first window. Other transcripts, nulls and blank ones have no row. Texts that
    repeat are searched once."""
    own = transcripts.select(key, F.array_join(words(F.col("text")), " ").alias("text"), F.size(words(F.col("text"))).cast("long").alias("n")).filter("n > 0")
    texts = staged(own.select("text", "n").distinct().withColumn("a", F.xxhash64("text")), "texts")
    sizes = texts.sparkSession.createDataFrame([(n,) for n in SIZES], "n long")
    every = entry_windows(entries, order, texts.select("n").unionByName(sizes).distinct())
    every = staged(every.select("n", "first", "last", F.col("window").alias("text"), F.xxhash64("first", "last").alias("b")), "windows")
    best = lambda pairs, by: pairs.join(every.select("b", "n", "first", "last"), "b").groupBy(*by).agg(F.max_by(F.struct(F.col("n").alias("words"), "first", "last", "score"), F.struct("score", -F.col("first"))).alias("m"))
    whole = staged(best(whole_pairs(texts, every), ["a"]), "whole")
    rest = texts.join(whole.select("a"), "a", "left_anti")
    part = best(part_pairs(rest, every.filter(F.col("n").isin(SIZES))), ["a", "n"]).groupBy("a").agg(F.max_by("m", "n").alias("m"))
    found = whole.unionByName(part).join(texts.select("a", "text"), "a").select("text", "m.*")
    return own.select(key, "text").join(found, "text").select(key, "words", "first", "last", F.round(F.col("score") / 100, 6).alias("score"))
