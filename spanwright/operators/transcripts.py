"""Whole transcripts beside a canon: the chains, lanes and chapters of `chains`, many transcripts at a time.

Transcripts are dealt over tasks as they stand in their table, a row each, and each task gets the canon's index in front of
them, as a join with a small table does. So only texts and results are shuffled, not the matches of every word."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import folded_words
from .search import CELLS, align_columns, align_pair

#: Words of the transcripts that are worked on together, and transcripts at most.
WORDS, MANY = 300_000, 2048
#: A step to the next place, over one to any other; no value.
NEXT, NONE = 1 << 24, -(1 << 50)


class Canon:
    """The index of a canon: forms by number, their places in order, adjacent forms, and chapters by form."""

    def __init__(self, rows: list[dict], common: int) -> None:
        self.ids: dict[str, int] = {}
        form = np.array([self.ids.setdefault(r["form"], len(self.ids)) for r in rows], dtype=np.int64)
        self.items = sorted({r["item"] for r in rows})
        number = {x: k for k, x in enumerate(self.items)}
        p = np.array([r["p"] for r in rows], dtype=np.int64)
        self.size = int(p.max(initial=-1)) + 1
        self.item, self.pos, self.split = np.full(self.size, -1), np.zeros(self.size, np.int64), np.zeros(self.size, bool)
        self.item[p], self.pos[p], self.split[p] = [number[r["item"]] for r in rows], [r["pos"] for r in rows], [r["split"] for r in rows]
        self.n = np.bincount(form, minlength=len(self.ids))
        self.rare = self.n <= common
        order = np.lexsort((form, p))
        self.p, self.form = p[order], form[order]
        self.from_p = np.searchsorted(self.p, np.arange(self.size + 1))
        self.slots = int(np.diff(self.from_p).max(initial=0))
        # the forms of each place, side by side
        self.wide = np.full((self.size, max(1, self.slots)), -1)
        self.wide[self.p, np.arange(len(self.p)) - self.from_p[self.p]] = self.form
        a, b = self._beside()
        key = self.form[a] * max(1, len(self.ids)) + self.form[b]
        order = np.lexsort((self.p[a], key))
        self.pair, self.pair_p = key[order], self.p[a][order]
        self.chapter = np.unique(np.stack([form, self.item[p]]), axis=1, return_counts=True) if len(p) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
        self.from_form = np.searchsorted(self.chapter[0][0], np.arange(len(self.ids) + 1))
        #: Chapters that were aligned: places, their forms, all forms.
        self.chapters: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _beside(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows of forms at adjacent places, one of them rare."""
        found = [(i, j) for i, p in enumerate(self.p.tolist()) if p + 1 < self.size for j in range(self.from_p[p + 1], self.from_p[p + 2]) if self.rare[self.form[i]] or self.rare[self.form[j]]]
        return tuple(np.array(found, dtype=np.int64).reshape(-1, 2).T)

    def heard(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(at, form) of the words that the canon has."""
        found = np.array([self.ids.get(w, -1) for w in words], dtype=np.int64)
        at = np.flatnonzero(found >= 0)
        return at, found[at]

    def candidates(self, forms: np.ndarray, top: int) -> list[tuple[int, int]]:
        """(chapter number, score) of the `top` chapters for words: `chains.chapter_candidates`."""
        each, heard = np.unique(forms, return_counts=True)
        many = self.from_form[each + 1] - self.from_form[each]
        rows = np.arange(many.sum()) + np.repeat(self.from_form[each] - np.cumsum(many) + many, many)
        chapter, score = self.chapter[0][1, rows], np.zeros(len(self.items), np.int64)
        np.add.at(score, chapter, np.repeat(heard * (1_000_000 // (1 + self.n[each])), many) * self.chapter[1][rows])
        found = np.unique(chapter)
        return [(int(k), int(score[k])) for k in found[np.argsort(-score[found], kind="stable")][:top]]

    def points(self, told: list[np.ndarray], reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(transcript, t, p) of the matches within `reach` of a seed, in order of p: `chains.near_seeds`."""
        gap, none = reach + 1, np.zeros(0, np.int64)
        # transcripts stand in one row of words, too far apart to meet
        begins = np.cumsum([gap, *(len(x) + gap for x in told)])
        line = np.full(begins[-1], -2, np.int32)
        for x, a in zip(told, begins, strict=False):
            line[a : a + len(x)] = x
        both = np.flatnonzero((line[:-1] >= 0) & (line[1:] >= 0))
        key = line[both].astype(np.int64) * max(1, len(self.ids)) + line[both + 1]
        a, b = np.searchsorted(self.pair, key), np.searchsorted(self.pair, key, "right")
        at = np.repeat(both, b - a)
        ps = self.pair_p[np.arange(len(at)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
        if not len(at):
            return none, none, none
        wide = np.full((self.size + 2 * gap, self.wide.shape[1]), -1, np.int32)
        wide[gap:-gap] = self.wide
        around, found = np.arange(-reach, reach + 1), []
        for k in range(0, len(at), 1000):
            t, p = at[k : k + 1000, None] + around, ps[k : k + 1000, None] + around
            hit = np.zeros((len(t), len(around), len(around)), bool)
            for forms in wide.T:
                hit |= line[t][:, :, None] == forms[p + gap][:, None, :]
            i, j, m = np.unravel_index(np.flatnonzero(hit), hit.shape)
            found.append(_distinct(p[i, m] * len(line) + t[i, j]))
        keys = _distinct(np.concatenate(found))
        p, t = keys // len(line), keys % len(line)
        own = np.searchsorted(begins, t, "right") - 1
        return own, t - begins[own], p

    def chains(self, told: list[np.ndarray], first: int | None, reach: int, adjacent: int) -> dict[int, list[tuple[int, int]]]:
        """The matches (t, p) of each transcript's best anchored chain, in order, by its number: `chains.best_chains`.

        A chain never leaves a stretch of one transcript's matches whose places are `reach` apart at most. Stretches without an
        anchor or with fewer than `adjacent` adjacent places have none; the others take their places in step, a place each."""
        own, t, p = self.points(told, reach)
        if not len(p):
            return {}
        forms = np.concatenate([np.zeros(0, np.int64), *told])[np.cumsum([0, *map(len, told)])[own] + t]
        anchor = self.rare[forms] & (True if first is None else t < first)
        order = np.lexsort((t, p, own))
        own, t, p, anchor = own[order], t[order], p[order], anchor[order]
        gap = np.where(np.diff(own, prepend=-1) != 0, reach + 1, np.diff(p, prepend=0))
        stretch = np.cumsum(gap > reach) - 1
        hopeful = (np.bincount(stretch, gap == 1) >= adjacent) & (np.bincount(stretch, anchor) > 0)
        kept = hopeful[stretch]
        own, t, p, anchor, gap, stretch = own[kept], t[kept], p[kept], anchor[kept], gap[kept], stretch[kept]
        n, span = len(p), 1 + max(map(len, told))
        if not n:
            return {}
        key = (own * (self.size + reach + 1) + p + reach) * span + t
        before = np.full((reach + 1, n), -1, np.int32)
        for d in range(1, reach + 1):
            wanted = key - d * span
            at = np.searchsorted(key, wanted) - 1
            before[d] = np.where((at >= 0) & (key[at] // span == wanted // span), at, -1)
        # a part of a joined word may follow the other part at its place, so those come one by one
        again = (gap == 0) & self.split[p]
        before[0] = np.where(again, np.arange(n) - 1, -1)
        steps = np.cumsum((gap != 0) | again)
        opens = np.flatnonzero(np.diff(stretch, prepend=-1))
        steps -= np.repeat(steps[opens], np.diff(opens, append=n))
        order = np.lexsort((np.arange(n), steps))
        back = np.empty(n + 1, np.int64)
        back[order], back[n] = np.arange(n), -1
        own, t, p, anchor, stretch, before = own[order], t[order], p[order], anchor[order], stretch[order], back[before[:, order]]
        # best values of chains without and with an anchor: each match's, and up to it among those of its place
        value, most, stands = np.full((2, n), -1), np.full((2, n + 1), NONE), np.zeros((2, n + 1), np.int64)
        link, kind = np.full((2, n), -1), np.zeros(n, np.int8)
        edges = np.flatnonzero(np.diff(steps[order], prepend=-1, append=n))
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            self._step(x, y, stretch, anchor, before, value, most, stands, link, kind)
        ends = np.flatnonzero((value[1] > 0) & (value[1] >> 24 >= adjacent))
        ends = ends[np.lexsort((t[ends], p[ends], -value[1][ends], own[ends]))]
        ends = ends[np.flatnonzero(np.diff(own[ends], prepend=-1))]
        out = {}
        for end in ends.tolist():
            chain, k, flag = [], end, 1
            while k >= 0:
                chain.append((int(t[k]), int(p[k])))
                k, flag = int(link[flag][k]), int(kind[k]) if flag else 0
            out[int(own[end])] = chain[::-1]
        return out

    def _step(self, x: int, y: int, stretch, anchor, before, value, most, stands, link, kind) -> None:
        """Values of the matches x..y, which are of one place in each stretch, by transcript places."""
        cols, at = np.arange(y - x), before[:, x:y]
        found = []
        for flag in (0, 1):
            got = most[flag][at]
            got[1] += NEXT
            best = got.argmax(0)
            top = got[best, cols] + 1
            found.append((np.where(top > 0, top, -1), np.where(top > 0, stands[flag][at[best, cols]], -1)))
        (plain, plain_at), (anchored, anchored_at) = found
        here = anchor[x:y]
        with_one = (anchored > plain) | (anchored == plain) & (anchored_at >= plain_at)
        one = np.where(here, np.where(with_one, anchored, plain), anchored)
        link[1, x:y] = np.where(here, np.where(with_one, anchored_at, plain_at), anchored_at)
        kind[x:y] = np.where(here & ~with_one, 0, 1)
        value[1, x:y] = np.where(here & (one < 0), 1, one)
        value[0, x:y] = np.where(here, -1, np.where(plain < 0, 1, plain))
        link[0, x:y] = np.where(here, -1, plain_at)
        base = np.cumsum(np.diff(stretch[x:y], prepend=-1) != 0) * (y - x)
        for flag in (0, 1):
            kinds, rank = np.unique(value[flag, x:y], return_inverse=True)
            rank = rank + base
            upto = np.maximum.accumulate(rank)
            where = np.maximum.accumulate(np.where(rank == upto, np.arange(x, y), -1))
            upto = kinds[upto - base]
            earlier = most[flag, at[0]]
            ahead = earlier > upto
            upto, where = np.where(ahead, earlier, upto), np.where(ahead, stands[flag, at[0]], where)
            most[flag, x:y], stands[flag, x:y] = np.where(upto > 0, upto, NONE), where

    def runs(self, chain: list[tuple[int, int]], at: np.ndarray, reach: int, early: int, settled: int, least: int, score: float) -> Iterator[tuple[tuple, list[int]]]:
        """((chapter number, doc_from, doc_to, canon_from, canon_to, matched, score), words) of a chain's runs: `chains.scored_runs`."""
        parts: list[list[tuple[int, int]]] = []
        for t, p in chain:
            last = parts[-1] if parts else None
            if last is None or self.item[p] != self.item[last[-1][1]] or p - last[-1][1] > (reach if len(last) >= settled else min(early, reach)):
                parts.append([])
            parts[-1].append((t, p))
        for part in parts:
            words, pos = [int(at[t]) for t, _ in part], [int(self.pos[p]) for _, p in part]
            a, b = min(pos), max(pos) + 1
            share = float(Decimal(repr(min(1.0, len(part) / (b - a)))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
            if len(part) >= least and share >= score:
                yield (int(self.item[part[0][1]]), min(words), max(words) + 1, a, b, len(part), share), [t for t, _ in part]

    def lanes(self, wanted: list[tuple[np.ndarray, int]], band: int, least: int) -> list[list[tuple[int, int]]]:
        """The matches (t, p) of words aligned with one chapter each, if it has `least`: `chains.aligned_lanes`."""
        out: list[list[tuple[int, int]]] = [[] for _ in wanted]
        pairs, of = [], []
        for k, (forms, item) in enumerate(wanted):
            if item not in self.chapters:
                places = np.flatnonzero(self.item == item)
                spelled = self.wide[places]
                self.chapters[item] = places, spelled, np.unique(spelled[spelled >= 0])
            places, spelled, known = self.chapters[item]
            if len(forms) < 10:
                continue
            # words that the chapter has not got are skipped by any best alignment
            kept = np.flatnonzero(np.isin(forms, known)) if len(places) <= band else np.arange(len(forms))
            if min(len(kept), len(places)) < least:
                continue
            if len(places) <= band and len(kept) * len(places) <= CELLS:
                pairs.append((forms[kept], spelled))
                of.append((k, kept, places))
                continue
            each = [x[x >= 0].tolist() for x in spelled]
            found = align_pair(forms.tolist(), each, {f: 1 / (1 + int(self.n[f])) for own in each for f in own}, band)
            out[k] = [(i, int(places[j])) for i, j in found] if len(found) >= least else []
        for (k, kept, places), found in zip(of, align_columns(pairs, 1 / (1 + self.n)), strict=True):
            out[k] = [(int(kept[i]), int(places[j])) for i, j in found] if len(found) >= least else []
        return out


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The keys in order, each once; sorting takes less time here than np.unique's hashes."""
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=-1) != 0]


Transcript = tuple[object, np.ndarray, np.ndarray]


def beside_canon(docs: DataFrame, index: DataFrame, doc: str, item: str, work: Callable[[Canon, list[Transcript]], Iterable[tuple]], schema: str, text: str = "text", common: int = 100) -> DataFrame:
    """The rows of `work` for the transcripts of docs, given the canon of `index` (`chains.flat_canon`) and some transcripts at
    a time: (key, places of the words that the canon has, their forms). A row of docs is a transcript of its own."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(docs.dtypes)
    entry = F.struct(F.col(item).alias("item"), "pos", "p", "form", "split").alias("e")
    chapters = index.groupBy(item).agg(F.collect_list(entry).alias("_canon")).select("_canon")
    bucket = F.pmod(F.xxhash64(doc), F.lit(parts)).cast("int")
    rows = docs.select(bucket.alias("_part"), F.lit(1).alias("_kind"), F.col(doc).alias("_doc"), folded_words(F.col(text)).alias("_words"))
    canon = chapters.crossJoin(spark.range(parts).select(F.col("id").cast("int").alias("_part"))).select("_part", F.lit(0).alias("_kind"), F.lit(None).cast(kinds[doc]).alias("_doc"), F.lit(None).cast("array<string>").alias("_words"), "_canon")
    every = canon.unionByName(rows, allowMissingColumns=True)
    dealt = every.repartitionById(parts, F.col("_part")).sortWithinPartitions("_kind")
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[dict] = []
        canon, own, size = None, [], 0

        def done() -> pa.RecordBatch:
            found = list(zip(*work(canon, own), strict=True)) or [()] * len(out)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, out, strict=True)], schema=out)

        for b in batches:
            for row in b.to_pylist():
                if row["_kind"] == 0:
                    entries += row["_canon"]
                    continue
                canon = canon or Canon(entries, common)
                own.append((row["_doc"], *canon.heard(row["_words"])))
                size += len(own[-1][1])
                if size >= WORDS or len(own) >= MANY:
                    yield done()
                    own, size = [], 0
        if own:
            yield done()

    return dealt.select("_kind", "_doc", "_words", "_canon").mapInArrow(run, schema)
