"""Search for passages of a fixed corpus ("canon") in documents, and similarity of short texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import words

#: Tasks for the documents of each of their partitions.
PARTS = 4
#: Cells of an alignment's table that are held as a whole.
CELLS = 1 << 25
#: Cells of the tables of pairs that are aligned together.
TOGETHER = 1 << 22


def positions(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, word), one row per word."""
    return df.select(key, F.posexplode(words(F.col(text))).alias("pos", "word"))


def inverted_index(canon: DataFrame, key: str) -> DataFrame:
    """(word, df, n, first_key): in how many rows a word is, how often, and the lowest key of those rows."""
    return positions(canon, key).groupBy("word").agg(F.countDistinct(key).alias("df"), F.count("*").alias("n"), F.min(key).alias("first_key"))


def grams(df: DataFrame, key: str, size: int) -> DataFrame:
    """(key, pos, gram): the hash of each `size` words."""
    own = df.select(key, words(F.col("text")).alias("w")).filter(F.size("w") >= size)
    at = F.sequence(F.lit(0), F.size("w") - size)
    return own.select(key, F.posexplode(F.transform(at, lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(size))))).alias("pos", "gram"))


def passage_runs(docs: DataFrame, canon: DataFrame, doc_key: str = "doc_id", canon_key: str = "item_id", size: int = 8, least: int = 4, score: float = 0.55, jump: int = 25) -> DataFrame:
    """Passages of the canon in documents: (doc, item, doc_from, doc_to, canon_from, canon_to, matched, score).

    Grams that both sides have meet in an equi-join on their hash; which side is sent around is left to Spark. Matches of
    one diagonal (document place less canon place) no more than `jump` words apart are a run; a run needs `least`
    words and `score`, matched words over its span. Documents without words, and nulls, have no run."""
    hits = grams(docs, doc_key, size).withColumnRenamed("pos", "at").join(grams(canon, canon_key, size), "gram")
    diagonal = hits.select(doc_key, canon_key, "at", "pos", (F.col("at") - F.col("pos")).alias("diag")).distinct()
    # a diagonal has one row for each canon place at most
    over = Window.partitionBy(doc_key, canon_key, "diag").orderBy("pos")
    opens = F.when(F.coalesce(F.col("pos") - F.lag("pos").over(over) > jump, F.lit(True)), 1).otherwise(0)
    fresh = F.least(F.lit(size), F.coalesce(F.lead("pos").over(over) - F.col("pos"), F.lit(size)))
    rows = diagonal.withColumn("opens", opens).withColumn("next_opens", F.coalesce(F.lead("pos").over(over) - F.col("pos") > jump, F.lit(True)))
    rows = rows.withColumn("own", F.when(F.col("next_opens"), F.lit(size)).otherwise(fresh)).withColumn("run", F.sum("opens").over(over))
    runs = rows.groupBy(doc_key, canon_key, "diag", "run").agg(
        F.min("at").alias("doc_from"), (F.max("at") + size).alias("doc_to"), F.min("pos").alias("canon_from"), (F.max("pos") + size).alias("canon_to"), F.sum("own").cast("long").alias("matched")
    )
    share = F.round(F.col("matched") / (F.col("canon_to") - F.col("canon_from")), 6)
    return runs.withColumn("score", share).filter((F.col("matched") >= least) & (F.col("score") >= score)).drop("diag", "run")


def match_gate(matches: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """A key that has a match of `least` or more keeps only such matches; any other keeps all."""
    best = matches.groupBy(key).agg(F.max("score").alias("_best"))
    return matches.join(best, key).filter((F.col("score") >= least) | (F.col("_best") < least)).drop("_best")


def primary_match(matches: DataFrame, key: str, item: str) -> DataFrame:
    """Of each key the longest match, then the best, then that of the lowest place."""
    rank = F.struct((F.col("doc_to") - F.col("doc_from")).alias("span"), "score", (-F.col("doc_from")).alias("at"), (-F.col(item)).alias("item"))
    return matches.groupBy(key).agg(F.max_by(F.struct(item, "doc_from", "doc_to", "score"), rank).alias("m")).select(key, "m.*")


def idf_candidates(docs: DataFrame, canon: DataFrame, doc_key: str = "doc_id", canon_key: str = "item_id", first: int = 60, top: int = 3) -> DataFrame:
    """The canon rows that each document's first words tell (a feature: openings tell passages apart): a word adds
    1 / (1 + n) for each time that a row has it, n being how often the canon has it, in millionths so that sums are exact;
    ties go to the lower key. Occurrences are counted by word and row before documents meet them, so a word that all rows
    have is one row of counts each, however often they have it."""
    counts = positions(canon, canon_key).groupBy("word", canon_key).agg(F.count("*").alias("many"))
    weight = counts.join(counts.groupBy("word").agg(F.sum("many").alias("all")), "word").withColumn("w", F.col("many") * F.floor(F.lit(1_000_000) / (1 + F.col("all"))))
    # the documents of a part of the input are a task's in all steps, so its memory doesn't grow with the input
    parts = max(PARTS * docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    opening = docs.select(doc_key, F.slice(words(F.col("text")), 1, first).alias("w")).repartition(parts, doc_key)
    heads = opening.select(doc_key, F.explode("w").alias("word")).groupBy(doc_key, "word").agg(F.count("*").alias("n"))
    sums = heads.join(weight, "word").groupBy(doc_key, canon_key).agg(F.sum(F.col("n") * F.col("w")).alias("score"))
    over = Window.partitionBy(doc_key).orderBy(F.col("score").desc(), canon_key)
    return sums.withColumn("place", F.row_number().over(over)).filter(F.col("place") <= top)


def window_matches(rows: DataFrame, key: str, order: str, count: str, want: int) -> DataFrame:
    """Windows of consecutive rows with `want` words in all, by an equi-join of prefix sums: (key, first, last)."""
    over = Window.partitionBy(key).orderBy(order)
    sums = rows.withColumn("upto", F.sum(count).over(over.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("upto") - F.col(count))
    starts = sums.select(key, F.col(order).alias("first"), (F.col("before") + want).alias("goal"))
    ends = sums.select(key, F.col(order).alias("last"), F.col("upto").alias("goal"))
    return starts.join(ends, [key, "goal"]).filter("last >= first").select(key, "first", "last")


def ratios(a: str, others: Iterable[str]) -> Iterator[float]:
    """Similarity of `a` with each of the others by insertions and deletions alone, 0 to 100: twice the longest common
    subsequence over both lengths. The table of a's characters, a bit for each place, is made once."""
    seen: dict[str, int] = {}
    for i, c in enumerate(a):
        seen[c] = seen.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    for b in others:
        v = full
        for c in b:
            u = v & seen.get(c, 0)
            v = (v + u | v - u) & full
        yield 200.0 * (len(a) - v.bit_count()) / (len(a) + len(b)) if a or b else 100.0


def ratio(a: str | None, b: str | None) -> float:
    """Similarity of two texts as in ratios(); null counts as empty, two empty texts are alike."""
    return next(ratios(a or "", [b or ""]))


def partial_ratio(a: str | None, b: str | None) -> float:
    """The best similarity of the shorter text with any stretch of the longer one that is as long, or shorter at either end."""
    short, long = sorted((a or "", b or ""), key=len)
    if not short:
        return 0.0 if long else 100.0
    n = len(short)
    return max(ratios(short, (long[max(0, k) : k + n] for k in range(1 - n, len(long)))))


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def fuzzy_partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def align_columns(pairs: list[tuple[np.ndarray, np.ndarray]], gain: np.ndarray) -> list[list[tuple[int, int]]]:
    """align_pair() of many pairs (heard forms, forms of each canon word with -1 where it has fewer) where the band leaves nothing
    out: the same tables, a canon word at a time over all heard words of pairs of like length. A word beyond a text's end is
    skipped by any best alignment."""
    found: list[list[tuple[int, int]]] = [[] for _ in pairs]
    slots, m = (max((c.shape[k] for _, c in pairs), default=0) for k in (1, 0))
    order = sorted((k for k, (h, c) in enumerate(pairs) if len(h) and len(c)), key=lambda k: -len(pairs[k][0]))
    while order:
        n = len(pairs[order[0]][0])
        part, order = order[: (many := max(1, TOGETHER // (n * m)))], order[many:]
        h, c = np.full((len(part), n), -2, np.int32), np.full((m, slots, len(part), 1), -1, np.int32)
        for k, i in enumerate(part):
            own, canon = pairs[i]
            h[k, : len(own)], c[: len(canon), : canon.shape[1], k, 0] = own, canon
        own, best = gain[h], np.zeros((len(part), n + 1))
        kept, diagonal = np.zeros((m, *h.shape), bool), np.zeros((m, *h.shape), bool)
        top, end = np.zeros(len(part)), np.zeros(len(part), np.int64)
        for j in range(m):
            same = h == c[j, 0]
            for x in c[j, 1:]:
                same |= h == x
            step = best[:, :-1] + np.where(same, own, -1.0)
            best[:, 1:] = np.maximum(step, best[:, 1:])
            np.maximum.accumulate(best, axis=1, out=best)
            diagonal[j] = step > best[:, :-1]
            kept[j] = np.maximum(step, best[:, :-1]) >= best[:, 1:]
            end[best[:, -1] > top] = j + 1
            np.maximum(top, best[:, -1], out=top)
        # the last heard word up to here at which the path turns
        turns = np.maximum.accumulate(np.where(kept & ~diagonal, np.int32(-1), np.arange(n, dtype=np.int32)), axis=2)
        for x, i in enumerate(part):
            (heard, canon), j, k, out = pairs[i], int(end[x]), n - 1, found[i]
            while j and k >= 0 and (k := int(turns[j - 1, x, k])) >= 0:
                while not kept[j - 1, x, k]:
                    j -= 1
                if diagonal[j - 1, x, k]:
                    if k < len(heard) and heard[k] in canon[j - 1]:
                        out.append((k, j - 1))
                    j -= 1
                k -= 1
            out.reverse()
    return found


def align_pair(heard: list[str], canon: list[str] | list[list[str]], weight: dict[str, float], band: int = 700) -> list[tuple[int, int]]:
    """Places (heard, canon) of a best alignment: either side may skip words free of cost, a match earns its word's
    weight, a mismatch costs 1; under ten heard words there is none. A canon word may be a list of spellings."""
    n, m = len(heard), len(canon)
    if n < 10 or not m:
        return []
    forms = [[w] if isinstance(w, str) else w for w in canon]
    codes = {w: k for k, w in enumerate(dict.fromkeys([*heard, *(w for x in forms for w in x)]))}
    h, c = np.array([codes[w] for w in heard]), np.full((max(map(len, forms)), m), -1)
    for j, x in enumerate(forms):
        c[: len(x), j] = [codes[w] for w in x]
    gain = np.array([weight.get(w, 0.5) for w in codes])
    if m <= band and n * m <= CELLS:
        return align_columns([(h, c.T)], gain)[0]
    width = min(m, 2 * band + 1)
    centres = [round(k * m / max(1, n - 1)) for k in range(n)]
    lows = [min(max(1, x - band), m - width + 1) for x in centres]
    best, diagonal, came = np.zeros(m + 1), np.zeros((n, width), bool), np.zeros((n, width), np.int32)
    for k, (lo, centre) in enumerate(zip(lows, centres, strict=True)):
        own, away = slice(lo, lo + width), np.abs(np.arange(lo, lo + width) - centre)
        step = best[lo - 1 : lo + width - 1] + np.where((c[:, lo - 1 : lo + width - 1] == h[k]).any(0), gain[h[k]], -1.0)
        step[away > band] = -np.inf
        diagonal[k] = step > best[own]
        row = np.maximum(best[own], step)
        top = np.maximum(np.maximum.accumulate(row), best[lo - 1])
        # the column that the best value up to here stands in; left of the band nothing has changed
        here = np.maximum.accumulate(np.where(row >= top, np.arange(lo, lo + width), 0))
        came[k] = here
        best[own] = top
        best[lo + width :] = np.maximum(best[lo + width :], top[-1])
    j, out = int(best.argmax()), []
    for k in range(n - 1, -1, -1):
        at = j - lows[k]
        if at < 0:
            continue
        at = min(at, width - 1)
        j = int(came[k, at])
        if j == 0:
            # the best value was carried from left of the band, where this word is skipped
            j = lows[k] - 1
            continue
        if diagonal[k, j - lows[k]]:
            if heard[k] in forms[j - 1]:
                out.append((k, j - 1))
            j -= 1
    return out[::-1]


def banded_alignment(pairs: DataFrame, keys: str, band: int = 700) -> DataFrame:
    """(keys..., heard array, canon array) -> (keys..., heard_at, canon_at): aligned words; `keys` as DDL. Arrow batches of pairs."""
    names = [x.split()[0] for x in keys.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for row in f.itertuples(index=False):
                canon = list(row.canon if row.canon is not None else [])
                many: dict[str, int] = {}
                for w in canon:
                    many[w] = many.get(w, 0) + 1
                found = align_pair(list(row.heard if row.heard is not None else []), canon, {w: 1 / (1 + n) for w, n in many.items()}, band)
                rows += [(*(getattr(row, x) for x in names), *p) for p in found]
            yield pd.DataFrame(rows, columns=[*names, "heard_at", "canon_at"])

    return pairs.select(*names, "heard", "canon").mapInPandas(run, f"{keys}, heard_at int, canon_at int")


def one_to_one_words(chunks: DataFrame, key: str, start: str, end: str, text: str) -> DataFrame:
    """A chunk's time shared equally among its words: (key, pos, word, start_ms, end_ms)."""
    own = chunks.select(key, start, end, words(F.col(text)).alias("w"))
    at = own.select(key, start, end, F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
    edge = lambda k: F.col(start) + F.floor((F.col(end) - F.col(start)) * k / F.col("n"))
    return at.select(key, "pos", "word", edge(F.col("pos")).alias("start_ms"), edge(F.col("pos") + 1).alias("end_ms"))
