"""Exact dedup: Patricia tries own the full byte strings of their part of the lengths and content hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import partitions, slices, stage, table

#: Bytes of strings that a trie holds before a subtree is spilled.
HELD = 24 << 20
#: Content-hash values of each band of lengths, for each shuffle partition; a spilled subtree is dealt by so many times more.
DEALT, FINER = 4, 256
_SPACE = b" \t\n\x0b\x0c\r"
#: Stands for a null doc_id in comparisons: after every other.
_LAST = 1 << 63


class Node:
    """One compressed edge: its label, the branches below by first byte, and the owner of the string that ends here."""

    __slots__ = ("branches", "label", "owner")

    def __init__(self, label: bytes, owner: list | None = None):
        self.label, self.owner, self.branches = label, owner, {}


class PatriciaTrie:
    """Full byte strings -> owners. `join` makes one owner of two; owners begin with (-code points, doc_id), so that of
    two the lesser one stays."""

    def __init__(self, join: Callable[[list, list], list]):
        self.root, self.join, self.size = Node(b""), join, 0

    def add(self, key: bytes, owner: list) -> list:
        """The owner of the terminal node after `owner` has joined it."""
        node, at = self.root, 0
        while at < len(key):
            below = node.branches.get(key[at])
            if below is None:
                node.branches[key[at]] = Node(key[at:], owner)
                self.size += len(key) - at
                return owner
            if key.startswith(below.label, at):
                node, at = below, at + len(below.label)
                continue
            same = len(commonprefix([below.label, key[at : at + len(below.label)]]))
            upper = Node(below.label[:same])
            below.label = below.label[same:]
            upper.branches[below.label[0]] = below
            node.branches[key[at]] = upper
            node, at = upper, at + same
        node.owner = owner if node.owner is None else self.join(node.owner, owner)
        return node.owner

    def strings(self, node: Node | None = None, above: bytes = b"") -> Iterator[tuple[bytes, list]]:
        """Every string with its owner."""
        stack = [(above, node or self.root)]
        while stack:
            above, node = stack.pop()
            key = above + node.label
            if node.owner is not None:
                yield key, node.owner
            stack += [(key, x) for x in node.branches.values()]

    def branches(self) -> int:
        """Nodes below which strings part."""
        stack, out = [self.root], 0
        while stack:
            node = stack.pop()
            out += len(node.branches) > 1
            stack += node.branches.values()
        return out

    def spill(self) -> tuple[bytes, list[tuple[bytes, list]]]:
        """Cut off the largest subtree below the first branching: the beginning that its strings share, and the strings."""
        node, above = self.root, b""
        while len(node.branches) == 1 and node.owner is None:
            (node,) = node.branches.values()
            above += node.label
        if not node.branches:
            return above, []
        below = max(node.branches.values(), key=lambda x: sum(len(k) for k, _ in self.strings(x)))
        out = list(self.strings(below, above))
        del node.branches[below.label[0]]
        self.size -= sum(len(n.label) for n in _nodes(below))
        return above + below.label[:1], out


def _nodes(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack += node.branches.values()


def normalized(text: bytes) -> bytes:
    return text.translate(None, _SPACE)


def code_points(text: bytes) -> int:
    return len(text.decode("utf-8", "surrogatepass"))


def part_of(key: bytes, parts: int) -> tuple[int, int]:
    """The band of the length and a short hash of the content: strings of different parts are different."""
    return len(key).bit_length(), xxhash.xxh3_64_intdigest(key) % parts


def _lesser(a: list, b: list) -> list:
    return a if a[:3] <= b[:3] else b


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows, closed once their texts and strings reach `most` bytes."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        cols = zip(*held, strict=True) if held else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes)) + (len(row[-1]["text"] or "") if isinstance(row[-1], dict) else 0)
        if size > most:
            yield batch()
            held, size = [], 0
    yield batch()


def _through_tries(rows: Iterator[tuple[tuple, bytes, list]], join: Callable, held: int) -> Iterator[tuple[bytes, list, bool]]:
    """(part, string, owner), a part's rows together -> (string, owner, whether the owner is final). A trie over `held`
    bytes spills subtrees, whose strings may come again, so they are not final."""
    last, trie, spilled = None, PatriciaTrie(join), []

    def close() -> Iterator[tuple[bytes, list, bool]]:
        for key, owner in trie.strings():
            yield key, owner, not key.startswith(tuple(spilled))

    for part, key, owner in rows:
        if part != last:
            yield from close()
            last, trie, spilled = part, PatriciaTrie(join), []
        trie.add(key, owner)
        while trie.size > held:
            start, out = trie.spill()
            if not out:
                break
            spilled.append(start)
            yield from ((k, o, False) for k, o in out)
    yield from close()


def _rounds(strings: DataFrame, run: Callable[[int], Callable], schema: str | StructType, parts: int, name: str) -> DataFrame:
    """Deal strings by part and merge them; what was spilled is dealt again, finer, until nothing is."""
    found = None
    while True:
        dealt = strings.repartition("band", "short").sortWithinPartitions("band", "short")
        parts *= FINER
        out = stage(dealt.mapInArrow(run(parts), schema), name)
        final = out.filter("final")
        found = final if found is None else found.unionByName(final)
        strings = out.filter("not final")
        if strings.isEmpty():
            return found


_LOCAL = "string long, row long, doc_id long, chars long, n long, band int, short long, key binary"
_MERGED = f"final boolean, {_LOCAL}, keep_row long, keep_id long, group_size long, hash binary"


def _arrow(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def _id(x: int | None) -> int:
    return _LAST if x is None else x


def _real(x: int) -> int | None:
    return None if x == _LAST else x


def exact_groups(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(doc_id, text, ...) -> one row per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space; a null text is an empty one. Of a group the row with
    the most code points stays, then that of the smallest doc_id (null last), then one of them: exactly one row of each
    group is kept, also where rows or doc_ids repeat. Very long texts are one string each; an empty table gives no
    rows; other columns are left out.

    Each task first puts its own rows into tries, so that a group of copies leaves it as one string with a number. The
    strings are dealt by (band of length, short content hash); a part's trie holds many strings, and the terminal node
    of a string owns the numbers that met there. Over `held` bytes subtrees are spilled and dealt again, finer. Only
    numbers are joined back, no text and no hash."""
    parts = DEALT * partitions(docs.sparkSession)
    local, merged = _arrow(_LOCAL), _arrow(_MERGED)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = strings = TaskContext.get().partitionId() << 40
        tries: dict[tuple, PatriciaTrie] = {}
        size = 0

        def join(a: list, b: list) -> list:
            return [min(a[0], b[0]), a[1], a[2] + b[2]]

        def flush() -> Iterator[tuple]:
            for part, trie in tries.items():
                for key, (rank, string, n) in trie.strings():
                    yield string, rank[2], _real(rank[1]), -rank[0], n, *part, key
            tries.clear()

        for b in batches:
            members = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                text = t or b""
                key, chars = normalized(text), code_points(text)
                trie = tries.setdefault(part_of(key, parts), PatriciaTrie(join))
                size -= trie.size
                owner = trie.add(key, [(-chars, _id(d), row), strings, 1])
                size += trie.size
                strings += owner[1] == strings
                members.append((owner[1], row, d, chars, 1, None, None, None))
                row += 1
                if size > held:
                    yield from _batches(flush(), local)
                    size = 0
            yield from _batches(iter(members), local)
        yield from _batches(flush(), local)

    def run(finer: int):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for b in batches:
                    for string, row, doc_id, chars, n, band, short, key in zip(*(b.column(k).to_pylist() for k in local.names), strict=True):
                        yield (band, short), key, [((-chars, _id(doc_id), row), string, n)]

            def out() -> Iterator[tuple]:
                for key, owner, final in _through_tries(rows(), lambda a, b: a + b if len(b) > 1 else a.append(b[0]) or a, held):
                    best, size = min(owner)[0], sum(x[2] for x in owner)
                    kept = (best[2], _real(best[1]), size, hashlib.sha256(key).digest()) if final else (None,) * 4
                    part = (None, None, None) if final else (*part_of(key, finer), key)
                    for rank, string, n in owner:
                        yield final, string, rank[2], _real(rank[1]), -rank[0], n, *part, *kept

            yield from _batches(out(), merged)

        return merge

    taken = stage(docs.select("doc_id", "text").mapInArrow(own, _LOCAL), "tasks")
    owners = _rounds(taken.filter("key is not null"), run, _MERGED, parts, "owners").select("string", "keep_row", "keep_id", "group_size", "hash")
    found = taken.filter("key is null").select("string", "row", "doc_id").join(owners, "string")
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("hash")).alias("text_sha256"))


def exact_stage(docs: DataFrame, held: int = HELD) -> DataFrame:
    """Of each group of equal texts, the one row that stays, with all its columns.

    Groups and the row that stays are those of exact_groups: a null text is empty, a null doc_id comes last, and of
    rows alike in code points and doc_id the one whose text is lowest stays (of repeated rows, one). Very long texts
    are one string each; an empty table gives no rows; no column name clashes, as rows travel whole inside one column.
    Whole rows go through the tries, a task's copies as one row: one shuffle, no join."""
    parts = DEALT * partitions(docs.sparkSession)
    dealt = StructType.fromDDL("final boolean, band int, short long, chars long, doc_id long").add("payload", docs.schema)
    schema = _arrow(dealt)

    def row_of(final: bool, owner: list, part: tuple) -> tuple:
        return final, *part, -owner[0], _real(owner[1]), owner[3]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[tuple, PatriciaTrie] = {}

        def out() -> Iterator[tuple]:
            size = 0
            for b in slices(batches):
                for payload in b.column(0).to_pylist():
                    text = (payload["text"] or "").encode("utf-8", "surrogatepass")
                    key = normalized(text)
                    trie = tries.setdefault(part_of(key, parts), PatriciaTrie(_lesser))
                    size -= trie.size
                    trie.add(key, [-code_points(text), _id(payload["doc_id"]), text, payload])
                    size += trie.size
                    if size > held:
                        yield from flush()
                        size = 0
            yield from flush()

        def flush() -> Iterator[tuple]:
            for part, trie in tries.items():
                yield from (row_of(False, owner, part) for _, owner in trie.strings())
            tries.clear()

        yield from _batches(out(), schema)

    def run(finer: int):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for b in slices(batches):
                    for _, band, short, chars, doc_id, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        text = (payload["text"] or "").encode("utf-8", "surrogatepass")
                        yield (band, short), normalized(text), [-chars, _id(doc_id), text, payload]

            out = (row_of(final, owner, part_of(key, finer)) for key, owner, final in _through_tries(rows(), _lesser, held))
            yield from _batches(out, schema)

        return merge

    strings = docs.select(F.struct(*docs.columns).alias("payload")).mapInArrow(own, dealt)
    return _rounds(strings, run, dealt, parts, "kept").select("payload.*")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents),
g AS (SELECT k, count(*) AS group_size, (array_agg(doc_id ORDER BY n DESC, doc_id))[1] AS keep_id FROM t GROUP BY k)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM t JOIN g USING (k)
"""
