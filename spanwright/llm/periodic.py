"""Periodic runs of words: string synchronising sets at dyadic scales.

A run has a smallest period q, is at least 4 q long, and no neighbouring word extends it. At scale t (1, 2, 4, ...) the
periods from t to 2 t - 1 are sought. A position belongs to the scale's synchronising set if, of the hashed stretches of
t words that begin in [i, i + t], that at one of the two ends is the smallest; stretches of period t / 4 or less are left
out of the choice. So the choice hangs on the 2 t words from i alone, and equal contexts are chosen alike. Any t positions
in a row hold a chosen one unless the 3 t - 1 words from them have a period of t / 4 or less, which no stretch that long
of a run of period t or more has. A run is 4 q >= q + 3 t long, so it has a chosen position i with i + q chosen as well,
and as the 2 t words are longer than q, i + q is the next position after i of equal context: each chosen position
proposes its distance to the next one like it. The stretches left out are those inside of runs of period t / 4 or less:
smaller scales have found them all, so such regions supply their own small periods and keep each set sparse.

Proposals are extended word by word on exact word numbers. If two contexts turn out to differ in spite of equal hashes,
the batch is done again with other hashes, so results never hang on a collision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, sized, table, texts

#: A run is so many periods and so many words long at least.
TIMES, LEAST = 4, 6
#: Words of many texts that are searched at once, unless one text has more.
WORDS = 1 << 18

_RUN = "struct<start:bigint,length:bigint,period:bigint>"
SCHEMA = f"doc_id bigint, n_words bigint, runs array<{_RUN}>, collapsed string"


class Collision(Exception):
    """Two different contexts have one hash."""


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor, shift and multiply by odd constants)."""
    x = x ^ np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & (1 << 64) - 1)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of x[i : i + width], for each i that has so many."""
    have = 1
    while 2 * have <= width:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    return x if have == width else np.minimum(x[: len(x) - (width - have)], x[width - have :])


def _synchronising(ids: np.ndarray, out: np.ndarray, scale: int) -> np.ndarray:
    """Positions whose smallest hash among the stretches from [i, i + scale] is at either end; `out` stretches don't count."""
    most = np.uint64((1 << 64) - 1)
    own = np.where(out, most, ids)
    low = _window_min(own, scale + 1)
    return np.flatnonzero((low < most) & ((own[: len(low)] == low) | (own[scale : scale + len(low)] == low)))


def _stretch(t: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch of this period around a position: its start and end. Compared in blocks that double."""
    end, step = at, 64
    while end + period < len(t):
        same = t[end : end + step][: len(t) - period - end] == t[end + period : end + period + step]
        k = int(same.argmin()) if not same.all() else len(same)
        end += k
        if k < len(same):
            break
        step *= 2
    start, step = at, 64
    while start:
        low = max(0, start - step)
        differ = np.flatnonzero(t[low:start] != t[low + period : start + period])
        if len(differ):
            start = low + int(differ[-1]) + 1
            break
        start, step = low, 2 * step
    return start, end + period if end > at else at


def find_runs(t: np.ndarray, longest: np.ndarray, seed: int = 0) -> np.ndarray:
    """Rows (start, length, period) of all runs of t, whose texts stand one after another with a number of its own
    between two; longest[i] is how many words the text of place i has and must not rise along t."""
    found: list[tuple[int, int, int]] = []
    ids, scale = _mix(t.astype(np.uint64), seed), 1
    while True:
        # texts that are long enough for this scale are a prefix
        n = int(np.searchsorted(-longest, -max(LEAST, TIMES * scale), side="right"))
        if not n or n < 2 * scale:
            return np.array(found, np.int64).reshape(-1, 3)
        t, ids = t[:n], ids[: n - scale + 1]
        double = _mix(ids[: n - 2 * scale + 1] * np.uint64(0xD6E8FEB86659FD93) + ids[scale : n - scale + 1], seed)
        edge = np.zeros(n + 1, np.int32)  # where a stretch of `scale` words lies in a highly periodic region
        for start, length, period in found:
            if TIMES * period <= scale <= length and start + length <= n:
                edge[start] += 1
                edge[start + length - scale + 1] -= 1
        places = _synchronising(ids, np.cumsum(edge)[: len(ids)] > 0, scale)
        context = double[places]
        order = np.lexsort((places, context))
        alike, sorted_places = context[order], places[order]
        apart = np.diff(sorted_places)
        near = np.flatnonzero((alike[1:] == alike[:-1]) & (apart >= scale) & (apart < 2 * scale))
        proposals = sorted(zip(apart[near].tolist(), sorted_places[near].tolist(), strict=True))
        last, start, end = 0, 0, -1
        for period, at in proposals:
            if period != last or at >= end - period:
                start, end = _stretch(t, at, period)
                if end - start >= max(LEAST, TIMES * period):
                    found.append((start, end - start, period))
            if at + period + 2 * scale > end:
                raise Collision
            last = period
        ids, scale = double, 2 * scale


def batch_runs(words: list[list[bytes]]) -> list[np.ndarray]:
    """For each text (as words) its runs, rows of (start, length, period) by start, then period."""
    order = sorted(range(len(words)), key=lambda k: -len(words[k]))
    lengths = np.array([len(words[k]) for k in order], np.int64)
    flat = [w for k in order for w in words[k]]
    codes = pd.factorize(np.fromiter(flat, object, len(flat)))[0] if flat else np.array([], np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1  # a number that no word has ends each text
    t, longest = np.empty(len(flat) + len(order), np.int64), np.repeat(lengths, lengths + 1)
    ends = begins + lengths
    inside = np.ones(len(t), bool)
    inside[ends] = False
    t[inside], t[ends] = codes, len(flat) + 1 + np.arange(len(order))
    for seed in range(64):
        try:
            found = find_runs(t, longest, seed)
            break
        except Collision:
            continue
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    owner = np.searchsorted(begins, found[:, 0], side="right") - 1
    found[:, 0] -= begins[owner]
    cut = np.searchsorted(owner, np.arange(len(order) + 1))
    out: list[np.ndarray] = [found[:0]] * len(words)
    for rank, k in enumerate(order):
        out[k] = found[cut[rank] : cut[rank + 1]]
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run repeats, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0)])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sized(batches, "text", 1 << 21):
        words = [x.split() for x in b.column("text").cast(pa.binary()).to_pylist()]
        runs: list[np.ndarray] = []
        k = 0
        while k < len(words):
            end, many = k + 1, len(words[k])
            while end < len(words) and many + len(words[end]) <= WORDS:
                many += len(words[end])
                end += 1
            runs += batch_runs(words[k:end])
            k = end
        flat = np.concatenate([np.empty((0, 3), np.int64), *runs])
        spans = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
        offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        texts_ = pa.array([collapse(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(offsets, spans), texts_], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_words, runs, collapsed): the runs of each whole text by start, then period, in
    word numbers from 0, and the text without the words that a run repeats after its first period.

    A null text is empty and has no run; repeated rows stay repeated; null ids stay null; other columns are not read and
    may have any name; an empty table gives no rows. Texts are searched together in pieces of bounded size, a text longer
    than that by itself; rows don't meet, so no group can grow hot."""
    return texts(docs).mapInArrow(_found, SCHEMA)


def longest_run(runs: Column) -> Column:
    """Of an array of runs the longest; ties: smallest start, then period. Null if there is none."""
    best = F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.get(best, F.lit(0))


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one document of ten, picked by the checksum of its id, the words from some place on repeat the
    first few from there: known periods for a test over any table. Null ids and texts without words stay as they are."""
    w = F.filter(F.split("text", SPACE), lambda x: x != "")
    own = texts(docs).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    own = own.withColumn("w", F.when(F.col("h") % 10 == 0, w)).withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.size("w"))
    own = own.withColumn("a", F.col("g") % F.when(F.col("n") > 0, F.col("n")))
    own = own.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    words = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1), lambda i: F.get("w", place(i).cast("int")))
    return own.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op11(spark, sf_dir: str) -> DataFrame:
    """Runs of `documents` with known periods in one of ten; null, empty and repeated rows as in periodic_runs."""
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents"))).withColumn("best", longest_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    every = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    length = -F.col("best.length")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
        F.sha2(every, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Equal words at each distance, as islands. The checksum is worked out byte by byte, -1 standing for one bit's step.
OP11_SQL = r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  xor(list_reduce(list_concat([4294967295], flatten(list_transform(regexp_extract_all(coalesce(doc_id::VARCHAR, ''), '.'), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) AS h FROM documents),
a AS (SELECT *, h // 10 AS g, len(w) AS n, CASE WHEN h % 10 = 0 AND doc_id IS NOT NULL AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS MATERIALIZED (SELECT k, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM p),
u AS (SELECT k, n, unnest(range(n)) AS i, unnest(w) AS word FROM t),
e AS (SELECT x.k, y.i - x.i AS q, x.i FROM u x JOIN u y ON x.k = y.k AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT k, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM e) GROUP BY k, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT * FROM s WHERE NOT EXISTS (FROM s z WHERE z.k = s.k AND z.q < s.q AND s.q % z.q = 0 AND z.start <= s.start AND z.start + z.length >= s.start + s.length)),
b AS (SELECT k, count(*) AS n_runs, arg_min(struct_pack(start := start, length := length, period := q), struct_pack(a := -length, b := start, c := q)) AS best, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM r GROUP BY k),
o AS (SELECT DISTINCT k, unnest(range(start + q, start + length)) AS i FROM r),
c AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN o USING (k, i) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM t LEFT JOIN b USING (k) LEFT JOIN c USING (k)"""
