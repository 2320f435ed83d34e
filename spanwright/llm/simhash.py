"""SimHash near-duplicates: pigeonhole blocks, then verified Hamming distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, texts
from .graph import connected_components

#: A bucket of more rows than this is split by further blocks.
BUCKET = 2048
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: bytes, size: int = 3) -> int:
    """The SimHash of UTF-8 text over its lower-cased (A-Z only) word shingles; no word: 0."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < size else [b" ".join(x) for x in zip(*(words[i:] for i in range(size)), strict=False)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(shingles), CHUNK):
        h = np.array([xxhash.xxh64_intdigest(x, 42) for x in shingles[k : k + CHUNK]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fp long): one row per document, whole texts; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _bits(mask: int) -> list[int]:
    return [i for i in range(64) if mask >> i & 1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def first_masks(distance: int) -> list[int]:
    """distance + 2 blocks of the 64 bits, two of which any close pair shares: one mask for each two blocks."""
    blocks = [sum(1 << int(i) for i in part) for part in np.array_split(np.arange(64), distance + 2)]
    return [a | b for k, a in enumerate(blocks) for b in blocks[:k]]


def next_masks(mask: int, distance: int) -> list[int]:
    """Of what the mask leaves free, distance + 1 blocks: any close pair that agrees on the mask agrees on one more block."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << int(i) for i in part) for part in np.array_split(np.array(free, int), distance + 1) if len(part)]


def _keys(fps: DataFrame, masks: Column) -> DataFrame:
    return fps.withColumn("mask", F.explode(masks)).withColumn("block", F.col("fp").bitwiseAND(F.col("mask")))


def local_roots(fps: np.ndarray, distance: int) -> np.ndarray:
    """For distinct fingerprints (rows of 64-bit words) of one bucket, the index of the root that each is linked to, by breadth-first search."""
    root, rest, left = np.arange(len(fps)), np.arange(len(fps)), fps
    while rest.size:
        seed, rest, left = rest[0], rest[1:], left[1:]
        stack = [seed]
        while stack and rest.size:
            near = np.bitwise_count(left ^ fps[stack.pop()]).sum(1, dtype=np.int64) <= distance
            if near.any():
                hit, rest, left = rest[near], rest[~near], left[~near]
                root[hit] = seed
                stack.extend(hit)
    return root


def _linker(distance: int):
    def links(mask: np.ndarray, block: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (mask[1:] != mask[:-1]), True])
        a, b = [], []
        for k in np.flatnonzero(np.diff(cut) > 1):
            own = fp[cut[k] : cut[k + 1]]
            root = local_roots(own.view(np.uint64).reshape(-1, 1), distance)
            linked = np.flatnonzero(root != np.arange(len(own)))
            a.append(own[linked])
            b.append(own[root[linked]])
        none = np.array([], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.array([], np.int64)] * 3
        for batch in batches:
            rows = [np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest)]
            mask, block, _ = rows
            if not len(mask):
                continue
            last = int(np.flatnonzero((mask != mask[-1]) | (block != block[-1])).max(initial=-1)) + 1
            yield links(*(r[:last] for r in rows)) if last else links(*(r[:0] for r in rows))
            rest = [r[last:] for r in rows]
        if len(rest[0]):
            yield links(*rest)

    return run


def links(classes: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(fp) distinct -> (a, b): links between different fingerprints at `distance` or fewer differing bits, so many
    that their components are those of all such links.

    The 64 bits are cut into distance + 2 blocks; a close pair agrees on two of them at least. Rows meet on each two
    blocks, and each bucket is searched with verified Hamming distances, one link from a row to its root at most. A
    bucket over `bucket` rows is dealt out again by further blocks of its free bits, level by level; distinct
    fingerprints that agree on most bits are few, so every bucket is bounded without dropping a row.
    """
    masks = [_signed(m) for m in first_masks(distance)]
    now, found = _keys(classes.select("fp"), F.array(*map(F.lit, masks))), None
    while True:
        heavy = stage(now.groupBy("mask", "block").count().filter(F.col("count") > bucket).select("mask", "block", F.lit(True).alias("heavy")), "heavy")
        some = not heavy.isEmpty()
        marked = now.join(heavy, ["mask", "block"], "left") if some else now.withColumn("heavy", F.lit(None).cast("boolean"))
        light = marked.filter("heavy is null").repartition("mask", "block").sortWithinPartitions("mask", "block", "fp")
        part = stage(light.select("mask", "block", "fp").mapInArrow(_linker(distance), "a long, b long"), "links")
        found = part if found is None else found.unionByName(part)
        if not some:
            return found
        after = {m: [_signed(x) for x in next_masks(m & (1 << 64) - 1, distance)] for m in masks}
        table = F.create_map(*(x for m, then in after.items() for x in (F.lit(m), F.array(*map(F.lit, then)))))
        now = stage(_keys(marked.filter("heavy").select("fp", F.col("mask").alias("was")), table[F.col("was")]).select("fp", "mask", "block"), "again")
        masks = sorted({x for then in after.values() for x in then})


def simhash_components(docs: DataFrame, size: int = 3, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (smallest doc_id reachable over links, itself included).

    Equal fingerprints are one class first, so a group of copies costs one row in the search. Null texts count as
    empty; documents without words share fingerprint 0; repeated rows stay repeated; an empty table gives no rows.
    """
    fps = stage(fingerprints(docs, size), "fingerprints")
    classes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = stage(connected_components(links(classes, distance, bucket)), "roots")
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stage(rooted, "rooted")
    components = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    of_class = stage(rooted.join(components, "root").select("fp", "component_id"), "of_class")
    return fps.join(of_class, "fp").select("doc_id", "fp", "component_id")


def op4(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
