"""Token-id files: canonical length-limited Huffman code, independent blocks, bit-offset checkpoints."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, partitions, slices, stage, table, texts
from .tokens import encoder

#: Longest code, in bits; the decoding table has 2 ** LONGEST entries.
LONGEST = 16
#: Tokens between two checkpoints.
EVERY = 256
#: A block is closed with the document that brings it to so many tokens.
BLOCK = 1 << 17
#: Tokens that are coded or counted at once.
CHUNK = 1 << 19
#: Beginning of each block, and the version of blocks and header.
MAGIC, VERSION = b"HUFB", 1
_HEADER = "version int, end_id long, longest int, lengths binary, crc32 long"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal code without a word over `longest` bits, by package-merge; a count of 0 has none."""
    used = np.flatnonzero(counts)
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols don't fit in codes of {longest} bits")
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    n, levels = len(order), []
    now, leaf = weight, np.ones(n, bool)
    for _ in range(longest - 1):
        levels.append(leaf)
        pairs = now[: len(now) // 2 * 2].reshape(-1, 2).sum(1)
        both, kind = np.concatenate([weight, pairs]), np.r_[np.ones(n, bool), np.zeros(len(pairs), bool)]
        by = np.argsort(both, kind="stable")
        now, leaf = both[by], kind[by]
    levels.append(leaf)
    take, out = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(levels):  # of each list's first `take` entries, the leaves get a bit and the pairs lead on
        leaves = int(leaf[:take].sum())
        out[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = out
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[s]:
            code <<= int(lengths[s]) - last
            last = int(lengths[s])
            codes[s] = code
            code += 1
    return codes


def decoding_table(lengths: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """For each `longest` bits, the symbol that they begin with and its length."""
    codes = canonical(lengths)
    symbols, sizes = np.zeros(1 << longest, np.uint32), np.ones(1 << longest, np.uint8)
    order = [s for s in np.lexsort((np.arange(len(lengths)), lengths)) if lengths[s]]
    at = 0
    for s in order:
        span = 1 << longest - int(lengths[s])
        symbols[at : at + span], sizes[at : at + span] = s, lengths[s]
        at += span
    assert not order or int(codes[order[0]]) == 0
    return symbols, sizes


def pack(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, list[np.ndarray]]:
    """Documents' ids, end to end -> their bits, each document from a byte's start; documents' byte offsets, one more
    than documents; and each document's checkpoints (bit offsets in it, from its second on)."""
    n = lengths[ids].astype(np.int64)
    total = np.r_[0, np.cumsum(n)]
    first = np.r_[0, np.cumsum(sizes)]
    bits = total[first[1:]] - total[first[:-1]]
    start = np.r_[0, np.cumsum(-(-bits // 8))]
    at = total[:-1] - np.repeat(total[first[:-1]] - 8 * start[:-1], sizes)
    word, shift = at >> 4, 32 - n - (at & 15)
    value = codes[ids].astype(np.int64) << shift
    room = int(start[-1]) // 2 + 3
    out = np.bincount(word, value >> 16, room) + np.bincount(word + 1, value & 0xFFFF, room)
    marks = [at[a + EVERY : b : EVERY] - 8 * s for a, b, s in zip(first[:-1], first[1:], start[:-1], strict=False)]
    return out.astype(">u2").tobytes()[: int(start[-1])], start, marks


def unpack(data: bytes, at: np.ndarray, counts: np.ndarray, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids from each bit offset of `at`, so many as `counts` has, end to end; all offsets advance together."""
    b = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
    b = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    by = np.argsort(-counts, kind="stable")
    pos, many = at[by].astype(np.int64), counts[by]
    width = int(many[0]) if len(many) else 0
    out = np.zeros((width, len(by)), np.uint32)
    for k in range(width):
        live = int(np.searchsorted(-many, -k, "left"))
        p = pos[:live]
        peek = b[p >> 3] >> (16 - (p & 7)).astype(np.uint32) & 0xFFFF
        out[k, :live] = symbols[peek]
        pos[:live] += sizes[peek]
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    return out.T[back][np.arange(width)[None, :] < counts[:, None]]


def write_block(start: int, doc_ids: list, sizes: list[int], bodies: list[bytes], marks: list[np.ndarray]) -> bytes:
    """Magic, version, CRC-32 of the rest; documents, tokens before this block; per document: id present, id, tokens, bytes; checkpoints; bits."""
    docs = np.array([(x is not None, x or 0, n, len(b)) for x, n, b in zip(doc_ids, sizes, bodies, strict=True)], "<i8").reshape(-1, 4)
    rest = struct.pack("<qq", len(docs), start) + docs.tobytes() + np.concatenate([np.array([], "<u4"), *marks]).astype("<u4").tobytes() + b"".join(bodies)
    return MAGIC + struct.pack("<II", VERSION, zlib.crc32(rest)) + rest


def read_block(block: bytes, symbols: np.ndarray, sizes: np.ndarray) -> tuple[int, list, np.ndarray, np.ndarray]:
    """Tokens before the block, doc_ids, tokens of each, and all ids. A block of another format or version, or one that has changed, is an error."""
    version, crc = struct.unpack_from("<II", block, 4) if block[:4] == MAGIC else (0, 0)
    block = block[12:]
    if version != VERSION:
        raise ValueError("not a block of this format")
    if zlib.crc32(block) != crc:
        raise ValueError("a block has changed since it was written")
    n, start = struct.unpack_from("<qq", block)
    docs = np.frombuffer(block, "<i8", 4 * n, 16).reshape(-1, 4)
    tokens, room = docs[:, 2], docs[:, 3]
    lanes = np.maximum(1, -(-tokens // EVERY))
    marks = np.frombuffer(block, "<u4", int((lanes - 1).sum()), 16 + 32 * n)
    first = np.r_[0, np.cumsum(lanes)]
    at = np.zeros(int(first[-1]), np.int64)
    opens = np.zeros(len(at), bool)
    opens[first[:-1]] = True
    at[~opens] = marks
    at += np.repeat(8 * np.r_[0, np.cumsum(room)][:-1], lanes)
    counts = np.full(len(at), EVERY, np.int64)
    counts[first[1:] - 1] = tokens - EVERY * (lanes - 1)
    ids = unpack(block[16 + 32 * n + marks.nbytes :], at, counts, symbols, sizes)
    return start, [int(x) if there else None for there, x in docs[:, :2]], tokens, ids


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, ids: little-endian unsigned 32-bit, end id appended): one row per row, whole texts.

    A null or empty text has the end id alone; repeated rows stay; an empty table gives no rows; other columns are left out."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(t) + end for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary")


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK tokens, a document at least."""
    at, held = 0, 0
    for k, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        held += size // 4
        if held >= CHUNK:
            yield batch.slice(at, k + 1 - at)
            at, held = k + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs over all documents; one row for each id and task is shuffled, one for each id collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in (x for batch in batches for x in _chunks(batch, "ids")):
            got = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4"))
            total = np.pad(total, (0, max(0, len(got) - len(total))))
            total[: len(got)] += got
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"]
    return counts


def write_token_files(tokens: DataFrame, to: str, end_id: int) -> None:
    """Write (doc_id, ids) in ascending doc_id order under the path `to`, so that it can be read from the path alone.

    Folder `header` has one row: version, end id, longest code, the lengths of the canonical code, and their CRC-32.
    Documents are coded where they lie, dealt by ranges of doc_id (null first) and joined into independent blocks, each
    with a CRC-32 of its own. A doc_id with many rows is dealt over as many ranges as it fills, by a hash of the bits;
    inside a range its rows are in order of their bits. Folder `blocks` has range, place in it, tokens before the block
    in its range, and the block; folder `ranges` has each range's tokens. Very long texts are one document of a block,
    found by its checkpoints; an empty table gives a header and no blocks; other columns are left out."""
    spark = tokens.sparkSession
    lengths = code_lengths(id_counts(tokens))
    header = [(VERSION, end_id, LONGEST, bytearray(lengths.tobytes()), zlib.crc32(lengths.tobytes()))]
    spark.createDataFrame(header, _HEADER).coalesce(1).write.parquet(f"{to}/header")
    codes, p = canonical(lengths), partitions(spark)
    cuts = tokens.approxQuantile("doc_id", [k / p for k in range(1, p)], 0.1 / p) if p > 1 else []
    cuts = np.array(cuts, np.float64)

    def ranges_of(doc_ids: pa.Array, bodies: list[bytes]) -> np.ndarray:
        there, ids = doc_ids.is_valid().to_numpy(zero_copy_only=False), doc_ids.fill_null(0).to_numpy()
        lo, hi = (np.searchsorted(cuts, ids, side) for side in ("left", "right"))
        for k in np.flatnonzero(there & (hi - lo > 1)):
            hi[k] = lo[k] + 1 + zlib.crc32(bodies[k]) % (hi[k] - lo[k])
        return np.where(there, hi, 0).astype(np.int32)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in _chunks(batch, "ids")):
            ids = b.column(1).to_pylist()
            packed, start, marks = pack(np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64), lengths, codes)
            bodies = [packed[x:y] for x, y in zip(start[:-1], start[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(ranges_of(b.column(0), bodies)), b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(bodies, pa.binary()), pa.array([m.astype("<u4").tobytes() for m in marks], pa.binary())], ["part", "doc_id", "n", "body", "marks"])

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before, rows, held = TaskContext.get().partitionId(), 0, 0, [], 0

        def close() -> pa.RecordBatch:
            ids, sizes, bodies, marks = zip(*rows, strict=True)
            block = write_block(before, ids, sizes, bodies, [np.frombuffer(m, "<u4") for m in marks])
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([before]), pa.array([held]), pa.array([block], pa.binary())], ["part", "seq", "before", "tokens", "block"])

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                rows.append(row)
                held += row[1]
                if held >= BLOCK:
                    yield close()
                    seq, before, rows, held = seq + 1, before + held, [], 0
        if rows:
            yield close()

    dealt = tokens.select("doc_id", "ids").mapInArrow(coded, "part int, doc_id long, n long, body binary, marks binary").repartitionById(p, F.col("part")).sortWithinPartitions("doc_id", "body")
    dealt.select("doc_id", "n", "body", "marks").mapInArrow(blocked, "part long, seq long, before long, tokens long, block binary").write.option("compression", "none").parquet(f"{to}/blocks")
    spark.read.parquet(f"{to}/blocks").groupBy("part").agg(F.sum("tokens").alias("tokens")).coalesce(1).write.parquet(f"{to}/ranges")


def read_token_files(spark: SparkSession, at: str, with_ids: bool = True) -> DataFrame:
    """The files under a path -> doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if asked
    for: one row per row that was written; blocks decode alone."""
    version, _, longest, lengths, crc = spark.read.schema(_HEADER).parquet(f"{at}/header").first()
    if version != VERSION or zlib.crc32(lengths) != crc:
        raise ValueError("not a header of this format")
    lengths = np.frombuffer(bytes(lengths), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, sizes = decoding_table(lengths, longest)
        for b in batches:
            for block, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start, doc_ids, tokens, ids = read_block(block, symbols, sizes)
                raw, cut = ids.astype("<u4").tobytes(), np.r_[0, np.cumsum(tokens)]
                parts = [raw[4 * x : 4 * y] for x, y in zip(cut[:-1], cut[1:], strict=False)]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(base + start + cut[:-1]), pa.array(tokens), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(parts, pa.binary())] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

    # one row for each range, as many as shuffle partitions
    before = {r["part"]: r["tokens"] for r in spark.read.parquet(f"{at}/ranges").collect()}
    sums, total = [], 0
    for part in sorted(before):
        sums += [F.lit(part), F.lit(total)]
        total += before[part]
    base = F.create_map(*sums)[F.col("part")] if sums else F.lit(0)
    blocks = spark.read.schema("part long, seq long, before long, tokens long, block binary").parquet(f"{at}/blocks")
    return blocks.select("block", base.cast("long").alias("base")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op2(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    tokens = stage(tokenize(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"), 2), "tokens", compression="zstd")
    to = new_path(spark, "token_files")
    write_token_files(tokens, to, 2)
    return read_token_files(spark, to, with_ids=False)
