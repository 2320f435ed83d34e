"""Near copies: SimHash fingerprints propose, the sets of shingles decide.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Of such texts the
512-bit fingerprints differ in 78 bits on average, with a deviation of 8. Cut by bits, so many differing bits would leave
no block whole. So shingles, not bits, are dealt over blocks: a block's fingerprint is the SimHash of its own few shingles,
and a differing shingle touches one block alone. Texts that share a block are joined and their Hamming distances verified,
at a limit of four deviations beyond; within the groups that this leaves, every link is verified by the sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_names, new_path, scratch, stage, texts
from .graph import connected_components
from .simhash import local_roots

#: Words of a shingle, the similarity of near copies, and how many of 512 bits may differ in a pair that is worth verifying.
SHINGLE, SIMILAR, LIMIT = 5, 0.8, 112
#: 64-bit words of a fingerprint; blocks; shingles that are dealt over the blocks at most.
WIDE, BLOCKS, DEALT = 8, 20, 80
#: A bucket of more fingerprints, or a group with more bytes of shingles, is searched in pairs of parts.
BUCKET, BYTES = 2048, 4 << 20
#: Bytes of a shingle's hash in a set, and of the table of bits by which sets of one task are compared at most.
HELD, TABLE = 5, 64 << 20
#: Words that are worked on at once, and rows whose bits are.
CHUNK, ROWS = 1 << 16, 1 << 14
#: Entries of a task's cache of words.
KNOWN = 250_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def majorities(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each stretch of hashes, a word with the bits that are set in over half of them."""
    sizes = np.diff(np.r_[starts, len(h)])
    counts = np.zeros((len(starts), 64), np.int32)
    for a in range(0, len(h), ROWS):
        b = min(a + ROWS, len(h))
        lo, hi = int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b, "left"))
        bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[lo:hi] += np.add.reduceat(bits, np.maximum(starts[lo:hi], a) - a, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def shingle_sets(words: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts, end to end -> (text, hash) of each distinct shingle, sorted; a text of fewer words is one shingle."""
    n, ends = len(words), np.cumsum(sizes)
    h, left = np.zeros(n, np.uint64), np.repeat(ends, sizes) - np.arange(n)
    for k in range(size):
        own = left[: n - k] > k
        h[: n - k] = np.where(own, h[: n - k] * _STEP + words[k:] + np.uint64(1), h[: n - k])
    text = np.repeat(np.arange(len(sizes)), sizes)
    first = np.arange(n) == (ends - sizes)[text]
    keep = (left >= size) | first
    text, h = text[keep], _mix(h[keep])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    return text[new], h[new]


def block_keys(text: np.ndarray, h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key of a block) for every block with a shingle. Of a text with over DEALT shingles those whose hash has
    as many leading zeros as it takes are dealt; near a power of two, a text's blocks are given for both numbers of zeros, so that
    texts of nearly equal size meet."""
    low, high = np.ceil(np.log2(np.maximum(1, count / DEALT))), np.ceil(np.log2(np.maximum(1, count / SIMILAR / DEALT)))
    own = _mix(h + _STEP)
    zeros = 63 - np.floor(np.log2(np.maximum(1, own >> np.uint64(11)).astype(float))).astype(np.int64) - 11
    texts_, keys = [], []
    for more in (False, True):
        level = (high if more else low).astype(np.int64)
        use = (zeros >= level[text]) & (not more or (high != low)[text])
        t, x = text[use], own[use]
        block = ((x & np.uint64(0xFFFFFFFF)) % np.uint64(BLOCKS)).astype(np.int64)
        order = np.lexsort((block, t))
        t, x, block = t[order], x[order], block[order]
        starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (block[1:] != block[:-1])]) if len(t) else np.zeros(0, np.int64)
        key = _mix(majorities(_mix(x + _STEP), starts) + (level[t[starts]] * BLOCKS + block[starts]).astype(np.uint64) * _STEP)
        texts_.append(t[starts])
        keys.append(key)
    t, key = np.concatenate(texts_), np.concatenate(keys)
    order = np.argsort(t, kind="stable")
    return t[order], key[order]


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, text_hash, node (hash of the set of shingles), wide (the fingerprint), keys (of its
    blocks), held (the set: the first HELD bytes of its shingles' hashes, in order)."""
    kinds = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("wide", pa.binary()), ("keys", pa.list_(pa.int64())), ("held", pa.binary())]
    schema = pa.schema(kinds)

    def rows(ids: list, hashes: list, words: list[int], sizes: list[int]) -> pa.RecordBatch:
        n = np.array(sizes, np.int64)
        text, h = shingle_sets(np.array(words, np.uint64), n, size)
        count = np.bincount(text, minlength=len(n))
        there = np.flatnonzero(count)
        starts = (np.cumsum(count) - count)[there]
        node, wide = np.zeros(len(n), np.uint64), np.zeros((len(n), WIDE), np.uint64)
        if len(there):
            node[there] = _mix(np.add.reduceat(_mix(h ^ _STEP), starts) + count[there].astype(np.uint64))
            for k in range(WIDE):
                wide[there, k] = majorities(_mix(h + np.array(k + 2, np.uint64) * _STEP), starts)
        t, key = block_keys(text, h, count)
        offsets = np.r_[0, np.cumsum(np.bincount(t, minlength=len(n)))].astype(np.int32)
        ends = np.r_[0, np.cumsum(count)]
        held = np.ascontiguousarray(h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :HELD])
        sets = [held[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
        cols = [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(node.view(np.int64)), pa.array([x.tobytes() for x in wide], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.view(np.int64))), pa.array(sets, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        ids, hashes, words, sizes = [], [], [], []
        for b in batches:
            for doc_id, text, text_hash in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = text.lower().split()
                if len(known) > KNOWN:
                    known.clear()
                for w in [w for w in set(own) if w not in known]:
                    known[w] = xxhash.xxh3_64_intdigest(w)
                words += [known[w] for w in own]
                sizes.append(len(own))
                ids.append(doc_id)
                hashes.append(text_hash)
                if len(words) >= CHUNK or len(ids) >= 10_000:
                    yield rows(ids, hashes, words, sizes)
                    ids, hashes, words, sizes = [], [], [], []
        yield rows(ids, hashes, words, sizes)

    own = texts(docs)
    return own.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, node long, wide binary, keys array<long>, held binary")


def near_tree(wide: list[bytes], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket's fingerprints those that are not a root, and the roots that they are linked to."""
    root = local_roots(np.frombuffer(b"".join(wide), "<u8").reshape(-1, WIDE), distance)
    linked = np.flatnonzero(root != np.arange(len(root)))
    return linked, root[linked]


def similar_tree(held: list[bytes], similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets of this similarity or more, a tree for each of their components, by breadth-first search.

    Shingles that only one set has can't be common; the others are columns of a table of bits, or where that would be
    large, lists of the sets that have them."""
    sizes = np.array([len(x) // HELD for x in held])
    padded = np.zeros((int(sizes.sum()), 8), np.uint8)
    padded[:, 8 - HELD :] = np.frombuffer(b"".join(held), np.uint8).reshape(-1, HELD)
    _, column, many = np.unique(padded.view(">u8").ravel(), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(held)), sizes), many[column] > 1
    number = np.cumsum(many > 1) - 1
    row, column, wide = row[shared], number[column[shared]], int((many > 1).sum())
    share = Fraction(str(similar))
    if len(held) * wide <= 8 * TABLE:
        table = np.zeros((len(held), -(-wide // 64) * 64), np.uint8) if len(held) * wide <= TABLE else None
        if table is None:
            bits = np.zeros((len(held), -(-wide // 64) * 8), np.uint8)
            np.bitwise_or.at(bits, (row, column >> 3), (1 << (column & 7)).astype(np.uint8))
        else:
            table[row, column] = 1
            bits = np.packbits(table, axis=1, bitorder="little")
        words = bits.view(np.uint64).reshape(len(held), -1)

        def common(k: int, left: np.ndarray) -> np.ndarray:
            return np.bitwise_count(words[left] & words[k]).sum(1, dtype=np.int64)
    else:
        order = np.argsort(column, kind="stable")
        starts, own = np.searchsorted(column[order], np.arange(wide + 1)), np.r_[0, np.cumsum(np.bincount(row, minlength=len(held)))]

        def common(k: int, left: np.ndarray) -> np.ndarray:
            lists = [row[order[starts[c] : starts[c + 1]]] for c in column[own[k] : own[k + 1]]]
            return np.bincount(np.concatenate([np.array([], np.int64), *lists]), minlength=len(held))[left]

    rest, a, b = np.arange(len(held)), [], []
    while rest.size:
        stack, rest = [int(rest[0])], rest[1:]
        while stack and rest.size:
            k = stack.pop()
            # i / (m + n - i) >= p / q
            near = common(k, rest) * (share.denominator + share.numerator) >= share.numerator * (sizes[k] + sizes[rest])
            hit, rest = rest[near], rest[~near]
            a.append(hit)
            b.append(np.full(len(hit), k))
            stack.extend(hit.tolist())
    none = np.array([], np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _linker(tree: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
    """Links of each (key, part), whose rows stand together."""

    def links(key: np.ndarray, part: np.ndarray, node: np.ndarray, sketch: list[bytes]) -> pa.RecordBatch:
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]), True]) if len(key) else np.zeros(1, int)
        a, b = [np.array([], np.int64)], [np.array([], np.int64)]
        for k in np.flatnonzero(np.diff(cut) > 1):
            own = slice(cut[k], cut[k + 1])
            x, y = tree(sketch[own])
            a.append(node[own][x])
            b.append(node[own][y])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.array([], np.int64)
        key, part, node, sketch = none, none, none, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, part, node = (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate((key, part, node)))
            sketch += batch.column(3).to_pylist()
            last = int(np.flatnonzero((key != key[-1]) | (part != part[-1])).max(initial=-1)) + 1
            if last:
                yield links(key[:last], part[:last], node[:last], sketch[:last])
                key, part, node, sketch = key[last:], part[last:], node[last:], sketch[last:]
        yield links(key, part, node, sketch)

    return run


def _dealt(members: DataFrame) -> DataFrame:
    """(node, key, parts) -> (key, part, node): a key of one part as it is; of more, each two parts together, whole."""
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    pairs = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: (F.col("parts") == 1) | (k != own)), lambda k: F.least(k, own) * F.col("parts") + F.greatest(k, own))
    return members.select("key", F.explode(pairs).alias("part"), "node")


def _linked(dealt: DataFrame, sketches_: DataFrame, column: str, tree: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], name: str) -> DataFrame:
    rows = dealt.join(sketches_.select("node", column), "node").repartition("key", "part").sortWithinPartitions("key", "part")
    return stage(rows.select("key", "part", "node", column).mapInArrow(_linker(tree), "a long, b long"), name)


def near_links(classes: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """(node, wide, keys) -> (a, b): links between nodes whose fingerprints differ in `limit` bits or fewer and that share
    a block, so many that their components are those of all such links.

    A bucket is searched in one task with verified Hamming distances; one of over `bucket` nodes is cut into parts, and
    each two parts are searched together, whatever its size. Nodes alone in a bucket leave before fingerprints are joined."""
    now = classes.select("node", F.explode("keys").alias("key"))
    sizes = stage(now.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    met = stage(now.join(sizes, "key").select("node", "key", F.ceil(F.col("n") / bucket).alias("parts")), "met")
    return _linked(_dealt(met), classes, "wide", lambda x: near_tree(x, limit), "near")


def similar_links(members: DataFrame, similar: float = SIMILAR, most: int = BYTES) -> DataFrame:
    """(node, key, held) -> (a, b): links between nodes of one group, told by key, whose sets have this Jaccard similarity
    or more, so many that their components are those of all such links in the group.

    A group is one task; one with more than `most` bytes of shingles is cut into parts, and each two of them are searched
    together. So a task's sets are bounded, and no link is lost; the tasks of one group grow with the square of its parts."""
    sizes = stage(members.groupBy("key").agg(F.ceil(F.sum(F.octet_length("held")) / most).alias("parts")), "sizes")
    met = members.select("node", "key").join(sizes, "key").select("node", "key", F.greatest("parts", F.lit(1)).alias("parts"))
    return _linked(_dealt(met), members, "held", lambda x: similar_tree(x, similar), "similar")


def near_components(docs: DataFrame, size: int = SHINGLE, similar: float = SIMILAR, limit: int = LIMIT, bucket: int = BUCKET, most: int = BYTES) -> DataFrame:
    """One row per row: doc_id, text_hash, and component (the same for near copies, directly or over others).

    Texts of the same shingles are one node first, so a group of copies costs one row in the search. A null text is empty;
    texts without words are one component; repeated rows stay repeated; very long texts are sketched whole, in slices;
    ties don't arise; an empty table gives no rows; other columns are left out. Nodes are 64-bit hashes of whole sets,
    shingles 40-bit ones. What is staged on the way is deleted once the result is written."""
    spark = docs.sparkSession
    path = new_path(spark, "components")
    with scratch(spark):
        own = stage(sketches(docs, size), "sketches")
        classes = stage(own.groupBy("node").agg(F.first("wide").alias("wide"), F.first("keys").alias("keys")), "classes")
        groups = stage(connected_components(near_links(classes, limit, bucket)), "groups")
        # sets are shuffled once, and of those only what is in a group is written
        members = own.select("node", "held").join(groups.withColumnRenamed("root", "key"), "node").groupBy("node").agg(F.first("key").alias("key"), F.first("held").alias("held"))
        roots = stage(connected_components(similar_links(stage(members, "members"), similar, most)), "roots")
        out = own.select("doc_id", "text_hash", "node").join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("component"))
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def near_duplicate_stage(docs: DataFrame, size: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """Of each component of near copies, the row of the smallest doc_id stays (null last), with all its columns.

    Where rows repeat with that doc_id, one of them stays: the one with the lowest hash of its text, and of equal texts any one.
    Null and empty texts, long texts and empty tables as in near_components; no column name clashes."""
    found = near_components(docs, size, similar)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("best")
    keep = found.groupBy("component").agg(best).select("best.doc_id", "best.text_hash")
    rows = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
    kept_id, kept_hash, many = new_names(docs, "_kept_id", "_kept_hash", "_many")
    keep = keep.select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash))
    keep = stage(keep.join(rows, F.col(kept_id).eqNullSafe(rows["doc_id"]) & (F.col(kept_hash) == rows["text_hash"])).select(kept_id, kept_hash, (F.col("rows") > 1).alias(many)), "keep")
    same = docs["doc_id"].eqNullSafe(F.col(kept_id)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(kept_hash))
    # the ids grow with the corpus, so they are never broadcast; hashing them spares a sort of the whole texts
    once = docs.join(keep.filter(~F.col(many)).hint("shuffle_hash"), same, "left_semi")
    again = keep.filter(many)
    if again.isEmpty():
        return once
    rest = docs.join(again.hint("shuffle_hash"), same).groupBy(kept_id, kept_hash).agg(F.first(F.struct(*(docs[c] for c in docs.columns))).alias(many))
    return once.unionByName(rest.select(f"{many}.*"))
