"""Best-fit packing by minimum bin slack over the histogram of lengths."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, stage, table, texts
from .tokens import encoder

LONGEST = 4096


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """[(length, copies)]: of what is available, the combination that fills `room` as far as any can.

    A bitset holds the reachable sums, lengths from the longest; it ends as soon as the room can be filled."""
    reach, steps = 1, []
    full = 1 << room
    inside = (full << 1) - 1
    for length in sorted(counts, reverse=True):
        left, size = min(counts[length], room // length), 1
        while left > 0:  # copies in powers of two
            size = min(size, left)
            steps.append((length, size, reach))
            reach |= reach << length * size & inside
            left, size = left - size, size * 2
        if reach & full:
            break
    at, out = reach.bit_length() - 1, {}
    for length, size, before in reversed(steps):
        if not before >> at & 1:
            at -= length * size
            out[length] = out.get(length, 0) + size
    return sorted(out.items(), reverse=True)


def bin_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first bin, copies a bin, offset in a bin) for every piece of the histogram.

    Minimum bin slack: a bin takes the longest length left, and the fullest combination beside it; the same bin is
    repeated while its lengths last. Each step uses up a length, so there are at most `capacity` of them."""
    left, used, plan, bins = {n: c for n, c in histogram.items() if c}, dict.fromkeys(histogram, 0), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        inside = {longest: 1}
        for length, copies in fullest({n: c for n, c in left.items() if c and n <= capacity - longest}, capacity - longest):
            inside[length] = inside.get(length, 0) + copies
        left[longest] += 1
        times, offset = min(left[n] // c for n, c in inside.items()), 0
        for length in sorted(inside, reverse=True):
            copies = inside[length]
            plan.append((length, used[length], used[length] + copies * times, bins, copies, offset))
            used[length] += copies * times
            left[length] -= copies * times
            if not left[length]:
                del left[length]
            offset += length * copies
        bins += times
    return plan


def cut_pieces(docs: DataFrame, path: str, end_id: int = 1, longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit): only documents over `longest`
    tokens are cut. A null text is empty and has its end id alone."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * longest)):
                    own = ids[at : at + 4 * longest]
                    rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), own))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32())] + [pa.array(x, pa.int64()) for x in cols[2:5]] + [pa.array(cols[5], pa.binary())] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(pieces: DataFrame, capacity: int = LONGEST) -> DataFrame:
    """Add sequence_id and offset to pieces with a `length` of 1 to `capacity`.

    Pieces of one length are interchangeable, so the bins are planned on the driver over the histogram of lengths
    alone (at most `capacity` numbers, counted over all pieces), and each piece finds its place by its rank among
    those of its length. Ranks are counted in two steps, inside a part of the input and over parts, so a length that a
    third of all pieces share is never in one task."""
    pieces = stage(pieces.withColumn("_part", F.spark_partition_id()), "pieces", compression="zstd")
    counts = stage(pieces.groupBy("length", "_part").agg(F.count("*").alias("n")), "counts")
    over = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("_base"))
    plan = bin_plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    plan = np.array(sorted(plan), np.int64).reshape(-1, 6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            wide = np.int64(1) << 40
            k = np.searchsorted(plan[:, 0] * wide + plan[:, 1], length * wide + rank, "right") - 1
            _, first, _, bins, copies, offset = plan[k].T
            sequence, slot = bins + (rank - first) // copies, offset + (rank - first) % copies * length
            keep = [n for n in b.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(sequence), pa.array(slot)], [*keep, "sequence_id", "offset"])

    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    # lengths times parts of the input: they grow with it, so they are never broadcast
    ranked = pieces.join(stage(base, "base").hint("shuffle_hash"), ["length", "_part"]).withColumn("_rank", F.col("_base") + F.row_number().over(inside) - 1)
    names = [f for f in pieces.schema if f.name != "_part"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", sequence_id long, offset long"
    return ranked.select(*(f.name for f in names), "_rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = LONGEST, with_ids: bool = False) -> DataFrame:
    return pack(cut_pieces(docs, path, end_id, capacity, with_ids), capacity)


def op9(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))
