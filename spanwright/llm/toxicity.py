"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import new_names, slices, stage, table, texts

#: Labelled rows of each class that the model is fitted on at most: those with the lowest hashes of doc_id.
SAMPLE = 4000
#: Terms that the model keeps for what each tells alone, and the chi-squared statistic that each needs.
TERMS, CHI = 8192, 12.0
#: Terms in most documents of the sample among which pairs are sought, pairs that are kept, and how far a pair's
#: statistic has to be above that of either of its terms: with so many pairs, chance gives less.
COMMON, PAIRS, BEYOND = 2048, 512, 40.0
#: Documents of the sample that a term needs.
LEAST = 5
#: Lengths of the word beginnings that are terms beside the word.
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
#: Entries of a task's cache of words.
CACHE = 250_000


def term_hashes(word: str) -> set[int]:
    return {zlib.crc32(word.encode()), *(zlib.crc32(b"%d:" % n + word[:n].encode()) for n in STEMS if len(word) >= n)}


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def text_terms(text: str) -> np.ndarray:
    return np.array(sorted({h for w in words(text) for h in term_hashes(w)}), np.uint32)


@dataclass
class FactorizationMachine:
    """P(toxic) = sigmoid(bias + sum of weights + sum over pairs of <v_i, v_j>) over the terms that a text has."""

    terms: np.ndarray  # sorted hashes
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # terms x factors

    def score(self, present: np.ndarray) -> float:
        v = self.factors[present]
        z = self.bias + self.weights[present].sum() + 0.5 * float((v.sum(0) ** 2).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def chi_squared(a: np.ndarray, total: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Of a presence that `a` of n1 documents with label 1 and total - a of n0 others have."""
    rate = total / (n1 + n0)
    return (a / n1 - (total - a) / n0) ** 2 / np.maximum(rate * (1 - rate), 1e-12) * n1 * n0 / (n1 + n0)


def telling_pairs(rows: list[np.ndarray], labels: np.ndarray, chi: np.ndarray, most: int = PAIRS, beyond: float = BEYOND) -> np.ndarray:
    """Terms (places in `chi`, their own statistics) of pairs that tell together far more than either does alone. Each
    term has the documents that it is in as bits, so a pair is counted by the bits that both have."""
    order = np.argsort(-labels, kind="stable")
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    bits = np.zeros((len(chi), -(-n1 // 64) * 64 + -(-n0 // 64) * 64), bool)
    for k, doc in enumerate(order):
        bits[rows[doc], k if labels[doc] else k - int(labels.sum()) + -(-n1 // 64) * 64] = True
    bits, ones, best = np.packbits(bits, axis=1).view(np.uint64), -(-n1 // 64), []
    for i in range(1, len(chi)):
        both = np.bitwise_count(bits[:i] & bits[i])
        a, total = both[:, :ones].sum(1, dtype=np.int64), both.sum(1, dtype=np.int64)
        gain = chi_squared(a, total, n1, n0) - np.maximum(chi[i], chi[:i])
        best += [(-float(gain[j]), i, int(j)) for j in np.flatnonzero((gain >= beyond) & (total >= LEAST))]
        best = sorted(best)[:most] if len(best) > 4 * most else best
    return np.unique([t for _, i, j in sorted(best)[:most] for t in (i, j)]).astype(int)


def fit(terms: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, share: float, factors: int = 4, rounds: int = 30, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> FactorizationMachine:
    """Adagrad on the logistic loss over documents' terms (places in `terms`, sorted hashes); `share` is the share of
    label 1 among all labelled rows, to which the bias is set back."""
    if not len(rows):
        return FactorizationMachine(terms[:0], -40.0, np.zeros(0), np.zeros((0, factors)))
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(terms)), rng.normal(0, 0.1, (len(terms), factors)), 0.0
    gw, gv, gb = np.full(len(terms), 1e-6), np.full((len(terms), factors), 1e-6), 1e-6
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for batch in np.array_split(order, max(1, len(order) // 64)):
            idx = np.concatenate([rows[k] for k in batch]) if len(batch) else np.array([], int)
            doc = np.repeat(np.arange(len(batch)), [len(rows[k]) for k in batch])
            own = v[idx]
            total = np.zeros((len(batch), factors))
            np.add.at(total, doc, own)
            z = bias + np.bincount(doc, w[idx], len(batch)) + 0.5 * ((total**2).sum(1) - np.bincount(doc, (own**2).sum(1), len(batch)))
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[batch]) / max(1, len(batch))
            gb += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(gb)
            slope = np.bincount(idx, g[doc], len(terms)) + decay * w
            gw += slope**2
            w -= rate * slope / np.sqrt(gw)
            slope = np.zeros_like(v)
            np.add.at(slope, idx, g[doc][:, None] * (total[doc] - own))
            slope += decay * v
            gv += slope**2
            v -= rate * slope / np.sqrt(gv)
    if 0 < share < 1 and 0 < labels.mean() < 1:
        bias += np.log(share / (1 - share)) - np.log(labels.mean() / (1 - labels.mean()))
    return FactorizationMachine(terms, float(bias), w, v)


def score(docs: DataFrame, model: FactorizationMachine, *keep: str, to: str = "score") -> DataFrame:
    """The kept columns, and the score as `to`: every word of every whole text counts, however long.

    A null or empty text has the score of a text without terms; repeated rows get equal scores; `to` has to be a new
    name; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(h): k for k, h in enumerate(model.terms)}
        known: dict[str, tuple[int, ...]] = {}
        none = model.score(np.array([], int))
        for b in slices(batches):
            out = []
            for text in b.column("text").to_pylist():
                own = words(text or "")
                if len(known) > CACHE:
                    known.clear()
                for w in [w for w in own if w not in known]:
                    known[w] = tuple(place[h] for h in term_hashes(w) if h in place)
                present = {k for w in own for k in known[w]}
                out.append(model.score(np.array(sorted(present), int)) if present else none)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(out, pa.float64())], [*keep, to])

    names = list(dict.fromkeys([*keep, "text"]))
    schema = StructType([docs.schema[n] for n in keep]).add(to, DoubleType())
    return docs.select(*names).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sample_terms(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, float]:
    """(toxic, terms array) of at most `sample` documents of each class that aren't held out, staged; and the share of
    label 1 among all such labelled documents. Of rows repeated with one doc_id, one counts."""
    own = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = stage(own.filter(~held_out(F.col("doc_id"))), "labels")
    share = own.agg(F.avg("toxic")).first()[0] or 0.0
    picked = [own.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    # 2 * sample rows at most, whatever the input
    chosen = F.broadcast(stage(picked[0].unionByName(picked[1]), "sample"))
    rows = texts(docs).join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [text_terms(t).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["toxic", "terms"])

    kind = dict(rows.dtypes)["toxic"]
    return stage(rows.select("toxic", "text").mapInArrow(run, f"toxic {kind}, terms array<long>"), "terms"), float(share)


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """Fit on at most `sample` rows of each class among those that aren't held out; the share of each class counts all of them.

    Texts stay in the executors. Terms are counted there; the driver gets the counts of at most TERMS + COMMON terms,
    and each sampled document's places among those. Terms are kept for what they tell alone, and in pairs. Null texts,
    labels and doc_ids are empty texts or left out; without labels nothing is known of label 1, and every score is next to 0."""
    found, share = sample_terms(docs, labels, sample)
    n1, n0 = found.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    counts = found.select(F.explode("terms").alias("term"), "toxic").groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("total")).filter(F.col("total") >= LEAST)
    counts = stage(counts, "term_counts")
    p1, p0, rate = F.col("a") / max(1, n1), (F.col("total") - F.col("a")) / max(1, n0), F.col("total") / max(1, n1 + n0)
    chi = (p1 - p0) * (p1 - p0) / F.greatest(rate * (1 - rate), F.lit(1e-12)) * (n1 * n0 / max(1, n1 + n0))
    counts = counts.withColumn("chi", chi)
    alone = counts.filter(F.col("chi") >= CHI).orderBy(F.desc("chi"), "term").limit(TERMS).select("term")
    common = counts.orderBy(F.abs(2 * F.col("total") - (n1 + n0)), "term").limit(COMMON).select("term", "chi")
    alone = np.sort(np.array([r[0] for r in alone.collect()], np.int64))
    common = {r[0]: r[1] for r in common.collect()}
    every = np.unique(np.r_[alone, np.array(list(common), np.int64)])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.searchsorted(every, x[np.isin(x, every)]).astype("<i2").tobytes() for x in (np.array(t, np.int64) for t in b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(own, pa.binary())], ["toxic", "own"])

    rows = sorted((r[0], bytes(r[1])) for r in found.mapInArrow(places, "toxic long, own binary").toLocalIterator())
    own, labels_ = [np.frombuffer(x, "<i2").astype(np.int32) for _, x in rows], np.array([y for y, _ in rows], np.int64)
    # among the common terms, by their places
    keys = np.array(sorted(common), np.int64)
    at = np.full(len(every), -1)
    at[np.searchsorted(every, keys)] = np.arange(len(keys))
    within = [at[x][at[x] >= 0] for x in own]
    paired = keys[telling_pairs(within, labels_, np.array([common[k] for k in keys.tolist()]))] if n1 and n0 else keys[:0]
    terms = np.unique(np.r_[alone, paired])
    at = np.full(len(every), -1)
    at[np.searchsorted(every, terms)] = np.arange(len(terms))
    return fit(terms.astype(np.uint32), [at[x][at[x] >= 0] for x in own], labels_, share)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a null doc_id is not held out."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit_on(docs, table(spark, sf_dir, "labels")), "doc_id")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the model does not reject, with all their columns; nulls, empty and long texts, repeated rows and
    empty tables as in score; no column name clashes."""
    (to,) = new_names(docs, "_score")
    return score(docs, fit_on(docs, labels), *docs.columns, to=to).filter(F.col(to) < 0.5).drop(to)
