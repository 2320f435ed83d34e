"""Suffix-array dedup: a sparse suffix array over minimiser positions finds passages that documents share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, stage, table, texts

#: Words of the shortest passage that is reported.
LEAST = 50
#: Words of a minimiser: of the LEAST - GRAM + 1 in any passage, the one with the lowest hash is selected.
GRAM = 8
#: Neighbours in suffix order that each suffix is compared with on either side, beside the next of another text.
NEAR = 4
#: Words that are worked on at once.
CHUNK = 1 << 19
_ONE = np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _sliding(x: np.ndarray, width: int, fold) -> np.ndarray:
    """fold over x[i : i + width] for each i; places past the end don't count."""
    fill = x.dtype.type(np.iinfo(x.dtype).max if fold is np.minimum else 0)
    now, have = x, 1
    while have < width:
        step = min(have, width - have)
        now = fold(now, np.r_[now[step:], np.full(min(step, len(now)), fill)])
        have += step
    return now


def minimisers(words: np.ndarray, sizes: np.ndarray, gram: int = GRAM, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Hashes of the words of several documents, end to end -> selected positions, their grams' hashes, and the least
    and greatest number of words that lie before the position in a window of which it is the minimiser."""
    n = len(words)
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h[: n - k] = h[: n - k] * np.uint64(0x9E3779B97F4A7C15) + words[k:]
    h = np.minimum(_mix(h), np.uint64((1 << 64) - 2))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    h[left < gram] = np.uint64((1 << 64) - 1)
    width = least - gram + 1
    low = _sliding(h, width, np.minimum)
    low[left < least] = 0  # a window belongs to one document
    best = _sliding(low[::-1], width, np.maximum)[::-1]
    at = np.flatnonzero((best == h) & (left >= gram))
    least_before, most_before = np.full(len(at), width), np.full(len(at), -1)
    for k in range(width):
        own = (at >= k) & (low[np.maximum(at - k, 0)] == h[at])
        least_before[own & (most_before < 0)] = k
        most_before[own] = k
    return at, h[at], least_before, most_before


def _chain(words: np.ndarray, at: np.ndarray, steps: int, way: int) -> np.ndarray:
    """16 bits of the hash of the first 1, 2, ... words beside `at`: two chains agree as far as the words do, and once
    they differ they stay different."""
    out = np.zeros((len(at), steps), ">u2")
    now = np.zeros(len(at), np.uint64)
    for k in range(steps):
        place = at + way * k
        now = _mix(now * np.uint64(0x9E3779B97F4A7C15) + words[np.clip(place, 0, len(words) - 1)] + _ONE)
        out[:, k] = (now >> np.uint64(48)).astype(np.uint16)
    return out


_NAMES = ["suffix", "before", "text", "pos", "room"]
_SCHEMA = "suffix binary, before binary, text binary, pos int, room long"


def _packed(*parts: np.ndarray) -> np.ndarray:
    """Four small numbers in one."""
    return sum(np.asarray(x, np.int64) << (15 * k) for k, x in enumerate(parts))


def _parts(packed: np.ndarray) -> list[np.ndarray]:
    return [(packed >> (15 * k)) & 0x7FFF for k in range(4)]


def _prefixes(chain: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... entries of each row."""
    out = np.zeros((len(chain), chain.shape[1] + 1), np.uint64)
    for k in range(chain.shape[1]):
        out[:, k + 1] = _mix(out[:, k] * np.uint64(0x9E3779B97F4A7C15) + chain[:, k].astype(np.uint64) + _ONE)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def suffixes(docs: DataFrame, gram: int = GRAM, least: int = LEAST) -> DataFrame:
    """(text_id binary, text) -> one row per minimiser: the suffix (its gram's hash, then the chain of the words after
    it), the chain of the words before it, and as `room` how many words there are to the right and to the left,
    `least - gram` at most, and how many at least and at most lie before it in its windows. A task leaves out texts
    that it has had."""
    reach = least - gram

    def rows(hashes: list[int], sizes: list[int], ids: list[bytes]) -> pa.RecordBatch:
        words, n = np.array(hashes, np.uint64), np.array(sizes, np.int64)
        at, h, least_before, most_before = minimisers(words, n, gram, least)
        doc = np.searchsorted(np.cumsum(n), at, "right")
        pos = at - (np.cumsum(n) - n)[doc]
        suffix = np.concatenate([h.astype(">u8").view(np.uint8).reshape(-1, 8), _chain(words, at + gram, reach, 1).view(np.uint8).reshape(-1, 2 * reach)], 1)
        before = _chain(words, at - 1, reach, -1).view(np.uint8).reshape(-1, 2 * reach)
        text = np.frombuffer(b"".join(ids), np.uint8).reshape(-1, 16)[doc]
        right, left = np.minimum(reach, n[doc] - pos - gram), np.minimum(reach, pos)
        return pa.RecordBatch.from_arrays([_binary(suffix), _binary(before), _binary(text), pa.array(pos.astype(np.int32)), pa.array(_packed(right, left, least_before, most_before))], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        known: dict[bytes, int] = {}
        hashes, sizes, ids = [], [], []
        for b in batches:
            for text_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text_id in seen:
                    continue
                seen.add(text_id)
                words = text.split()
                if len(words) < least:
                    continue
                if len(known) > 1_000_000:
                    known.clear()
                for w in [w for w in set(words) if w not in known]:
                    known[w] = xxhash.xxh3_64_intdigest(w)
                hashes += [known[w] for w in words]
                sizes.append(len(words))
                ids.append(text_id)
                if len(hashes) >= CHUNK:
                    yield rows(hashes, sizes, ids)
                    hashes, sizes, ids = [], [], []
        if sizes:
            yield rows(hashes, sizes, ids)

    return docs.select("text_id", "text").mapInArrow(run, _SCHEMA)


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where((a == b).all(1), a.shape[1], (a != b).argmax(1))


class _Compared:
    """Sorted suffixes, batch by batch: each is compared with its neighbours and matches are extended both ways."""

    def __init__(self, gram: int, least: int, near: int):
        self.gram, self.least, self.near, self.reach = gram, least, near, least - gram

    def arrays(self, b: pa.RecordBatch) -> list[np.ndarray]:
        width = {"suffix": 8 + 2 * self.reach, "before": 2 * self.reach, "text": 16}
        out = [np.frombuffer(b"".join(b.column(n).to_pylist()), np.uint8).reshape(-1, w) for n, w in width.items()]
        return [*out, *(b.column(n).to_numpy().astype(np.int64) for n in ("pos", "room"))]

    def passages(self, rows: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Rows of which some passage of `least` words or more is in another text too, and where it begins and ends;
        then rows, starts and hashes of the windows that a suffix further away may have too."""
        suffix, before, text, pos, room = rows
        right, left, least_before, most_before = _parts(room)
        n = len(pos)
        chain, back = suffix[:, 8:].copy().view(">u2"), before.copy().view(">u2")
        ids = text.copy().view("V16").ravel()
        start, end = pos.copy(), pos.copy()
        change = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        after = np.r_[change, n][np.searchsorted(change, np.arange(n), "right")]
        prior = np.r_[0, change][np.searchsorted(change, np.arange(n), "right")] - 1
        here = np.arange(n)
        pairs = [(here[:-d], here[d:]) for d in range(1, self.near + 1) if d < n]
        pairs += [(here[after < n], after[after < n]), (prior[prior >= 0], here[prior >= 0])]
        for a, b in pairs:
            ok = (suffix[a, :8] == suffix[b, :8]).all(1) & (ids[a] != ids[b])
            a, b = a[ok], b[ok]
            r = np.minimum(_equal(chain[a], chain[b]), np.minimum(right[a], right[b]))
            lead = np.minimum(_equal(back[a], back[b]), np.minimum(left[a], left[b]))
            ok = lead + self.gram + r >= self.least
            for own in (a[ok], b[ok]):
                np.minimum.at(start, own, pos[own] - lead[ok])
                np.maximum.at(end, own, pos[own] + self.gram + r[ok])
        found = np.flatnonzero(end > pos)
        return found, start[found], end[found], *self.windows(rows, chain, back, start, end)

    def windows(self, rows: list[np.ndarray], chain: np.ndarray, back: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order is by suffix, so suffixes past the last neighbour that is compared agree with this one to the right
        no further than that neighbour does. A window of this minimiser that needs no more of the right than that may be
        shared with one of them. Those in what was found are known to be shared, but a suffix further away may have
        nothing else to meet: of them, each window stays with two texts."""
        suffix, _, text, pos, room = rows
        right, _, least_before, most_before = _parts(room)
        here, agree = np.arange(len(pos)), np.full(len(pos), -1)
        for a, b in ((here[: -self.near], here[self.near :]), (here[self.near :], here[: -self.near])):
            same = (suffix[a, :8] == suffix[b, :8]).all(1)
            a, b = a[same], b[same]
            agree[a] = np.maximum(agree[a], np.minimum(_equal(chain[a], chain[b]), right[a]))
        some = np.flatnonzero((agree >= 0) & (self.reach - agree <= most_before))
        # words of the window before the minimiser
        ahead = np.arange(self.reach + 1)[None, :]
        inside = (ahead <= (pos - start)[some, None]) & (ahead >= (pos + self.least - end)[some, None])
        first = np.maximum(least_before, self.reach - agree)[some, None]
        row, ahead = np.nonzero((ahead >= first) & (ahead <= most_before[some, None]))
        gram = suffix[some, :8].copy().view(">u8").ravel().astype(np.uint64)
        to_left, to_right = _prefixes(back[some])[row, ahead], _prefixes(chain[some])[row, self.reach - ahead]
        keys = _mix(_mix(gram[row] + np.uint64(0x9E3779B97F4A7C15) * to_left) + to_right)
        known = np.flatnonzero(inside[row, ahead])
        stay = np.r_[np.flatnonzero(~inside[row, ahead]), known[self.witnesses(keys[known], text[some[row[known]]])]]
        row, ahead, keys = row[stay], ahead[stay], keys[stay]
        return some[row], pos[some[row]] - ahead, keys.view(np.int64)

    @staticmethod
    def witnesses(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Places of the first and the last text of each key: two different ones wherever there are two."""
        order = np.lexsort((text[:, 8:].copy().view("<u8").ravel(), text[:, :8].copy().view("<u8").ravel(), keys))
        new = keys[order][1:] != keys[order][:-1]
        return order[np.r_[True, new] | np.r_[new, True]] if len(keys) else order

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """text, start, end of what is found; windows left to compare by hash; and the first and last rows as they are, for the neighbours in other parts."""
        held, first = None, True
        for b in batches:
            if not b.num_rows:
                continue
            rows = self.arrays(b)
            # a text's own suffix from another task is the same row
            if held is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(held, rows, strict=True)]
            same = np.r_[False, (rows[3][1:] == rows[3][:-1]) & (rows[2][1:] == rows[2][:-1]).all(1)]
            rows = [x[~same] for x in rows]
            found, start, end, left, begin, keys = self.passages(rows)
            yield self.out(rows[2][found], start, end)
            yield self.out(rows[2][left], begin, begin + self.least, keys)
            if first:
                yield self.edge([x[: self.near] for x in rows])
                first = False
            held = [x[-self.near :] for x in rows]
        if held is not None:
            yield self.edge(held)

    _FOUND = ["found", "start", "end", "window"]
    _SCHEMA = "found binary, start long, end long, window long, " + _SCHEMA

    def out(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, window: np.ndarray | None = None) -> pa.RecordBatch:
        n = len(start)
        none = [pa.nulls(n, pa.binary())] * 3 + [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())]
        return pa.RecordBatch.from_arrays([_binary(text), pa.array(start), pa.array(end), pa.nulls(n, pa.int64()) if window is None else pa.array(window), *none], [*self._FOUND, *_NAMES])

    def edge(self, rows: list[np.ndarray]) -> pa.RecordBatch:
        n = len(rows[3])
        own = [_binary(x) for x in rows[:3]] + [pa.array(rows[3].astype(np.int32)), pa.array(rows[4])]
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.binary()), *[pa.nulls(n, pa.int64())] * 3, *own], [*self._FOUND, *_NAMES])


def passages(docs: DataFrame, gram: int = GRAM, least: int = LEAST, near: int = NEAR) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, start_word, end_word, n_words: the passages of `least` words or more that another
    document has too, overlapping ones joined; documents without any have no row.

    Words are divided by ASCII white space. Suffixes at minimisers are sorted over the whole corpus, dealt by ranges
    of suffix, context, text and position, so that no passage, however frequent, is one task's; each is compared with its neighbours and
    matches are extended to the left and right. Windows that a suffix further away in the order could have too, found or not, are then
    grouped by hash, so no match is missed where very many texts share a phrase. Suffixes on both sides of a cut between parts, a few for each part, are
    compared in a second step. Equal texts are one text in the search, and copies of each other as a whole. A null text
    is empty; repeated rows are copies of each other; passages that one text has twice don't count; an empty table
    gives no rows. Passages are compared by hashes: one can be a word too long in one of 65,536 cases."""
    spark = docs.sparkSession
    own = texts(docs).withColumn("text_id", F.unhex(F.md5("text")))
    order = ["suffix", "before", "text", "pos"]
    kernel = _Compared(gram, least, near)
    sorted_ = suffixes(own, gram, least).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    first = stage(sorted_.mapInArrow(kernel.run, kernel._SCHEMA), "compared")
    # as many rows as there are partitions, times twice the neighbours: they are picked out where they lie, then sent to one task
    edges = first.filter("suffix is not null").select(*_NAMES).repartition(1).sortWithinPartitions(*order)
    every = first.unionByName(stage(edges.mapInArrow(kernel.run, kernel._SCHEMA), "edges")).filter("found is not null").select(*kernel._FOUND)
    further = every.filter("window is not null")
    common = further.groupBy("window").agg(F.min(F.xxhash64("found")).alias("a"), F.max(F.xxhash64("found")).alias("b")).filter("a < b").select("window")
    found = every.filter("window is null").unionByName(further.join(common, "window", "left_semi"))
    spans = found.groupBy(F.col("found").alias("text_id")).agg(F.array_sort(F.collect_set(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))).alias("spans"))

    def join(done, x):
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["e"] >= x["s"]), longer).otherwise(F.concat(done, F.array(x)))

    spans = stage(spans.select("text_id", F.aggregate("spans", F.array().cast("array<struct<s:bigint,e:bigint>>"), join).alias("spans")), "spans")
    sized = own.select("doc_id", "text_id", F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long").alias("n"))
    sized = stage(sized.filter(F.col("n") >= least), "sized")
    copies = stage(sized.groupBy("text_id").agg(F.count("*").alias("c")).filter("c > 1").select("text_id"), "copies")
    whole = sized.join(copies, "text_id").select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"))
    alone = sized.join(copies, "text_id", "left_anti").join(spans, "text_id").select("doc_id", F.explode("spans").alias("x"))
    every = whole.unionByName(alone.select("doc_id", F.col("x.s").alias("start_word"), F.col("x.e").alias("end_word")))
    return every.withColumn("n_words", F.col("end_word") - F.col("start_word"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
