import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.llm import nearcopies


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def slow_components(sets, similar=0.8):
    """Which texts near copies connect, over all pairs."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    return {n: find(n) for n in range(len(sets))}


def groups(of):
    out = {}
    for k, v in of.items():
        out.setdefault(v, set()).add(k)
    return {frozenset(x) for x in out.values()}


def near_texts(seed, count):
    rng = random.Random(seed)
    letters = "abcdefghij"
    own = lambda n: ["".join(rng.choice(letters) for _ in range(4)) for _ in range(n)]
    out = []
    for size in [6, 8, 20, 40, 81, 100, 160, 320, 500, 2000]:
        base = own(size)
        for k in range(count):
            text = list(base)
            for _ in range(k % 4 * size // 200):
                text[rng.randrange(size)] = own(1)[0]
            out.append(" ".join(text + own(k % 2)))
    return out


def test_sketches_hold_the_whole_set_of_shingles(odd, nothing):
    rows = odd.select("doc_id", "text").collect()
    got = nearcopies.sketches(odd).collect()
    assert len(got) == len(rows) and nearcopies.sketches(nothing).count() == 0
    hashes = {r[0]: r[1] for r in odd.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    node = {r.text_hash: r.node for r in got}
    sets = {}
    for r in rows:
        sets.setdefault(shingles(r.text), set()).add(node[hashes[r.text or ""]])
    assert all(len(x) == 1 for x in sets.values()) and len({x for s in sets.values() for x in s}) == len(sets)


def test_bits_are_majorities():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    starts = np.array([0, 1, 3, 7, 20_000, 39_999])
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(h)], strict=True)):
        want = sum(1 << i for i in range(64) if 2 * int((h[a:b] >> np.uint64(i) & np.uint64(1)).sum()) > b - a)
        assert int(nearcopies.majorities(h, starts)[k]) == want


@pytest.mark.parametrize("bucket,most", [(nearcopies.BUCKET, nearcopies.BYTES), (4, 3000), (3, 900)])
def test_components_equal_all_pairs(spark, bucket, most):
    """Groups of every size, in one piece and in many parts: the same as of all pairs by Jaccard similarity."""
    texts = near_texts(3, 8) + ["", "one two", "one two"]
    want = groups(slow_components([shingles(t) for t in texts]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = nearcopies.near_components(df, bucket=bucket, most=most).collect()
    assert len(found) == len(texts)
    assert groups({r.doc_id: r.component for r in found}) == want
    assert any(len(g) > 4 for g in want) and len(want) > 10


def edited(rng, base, edits):
    text = list(base)
    for k in rng.sample(range(len(text)), edits):
        text[k] = f"e{rng.randrange(10**9)}"
    return " ".join(text)


def test_one_crowded_block_and_a_chain(spark):
    """A large group that only its base connects (copies of it are under 0.8 to each other), a chain of texts each near
    the next alone, and texts that share half of their shingles; blocks and groups are cut into many parts."""
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, half = words(120), words(60)
    texts = [" ".join(base)] + [edited(rng, base, 2) for _ in range(150)]
    chain = words(130)
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 30, 5)]
    texts += [" ".join(half + words(60)) for _ in range(60)]
    sets = [shingles(t) for t in texts]
    want = groups(slow_components(sets))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = nearcopies.near_components(df, bucket=8, most=4000).collect()
    assert groups({r.doc_id: r.component for r in found}) == want
    assert sum(5 * len(a & b) < 4 * len(a | b) for k, a in enumerate(sets[1:151]) for b in sets[1 : k + 1]) > 2000
    assert sorted(map(len, want))[-2:] == [6, 151]


@pytest.mark.parametrize("table", [nearcopies.TABLE, 40_000, 0])
def test_tree_of_similar_sets(monkeypatch, table):
    monkeypatch.setattr(nearcopies, "TABLE", table)
    rng = np.random.default_rng(6)
    base = [rng.choice(1 << 40, int(rng.integers(1, 90)), replace=False) for _ in range(9)]
    sets = []
    for k in range(120):
        x = base[k % 9]
        sets.append(set(x[rng.random(len(x)) > 0.08].tolist()) | set(rng.integers(0, 1 << 40, int(rng.integers(0, 6))).tolist()))
    sets += [set(), {7}, {7}]
    held = [b"".join(int(v).to_bytes(5, "big") for v in sorted(s)) for s in sets]
    a, b = nearcopies.similar_tree(held, 0.8)
    root = list(range(len(sets)))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])
        root = [root[y] if r == root[x] else r for r in root]
    assert groups(dict(enumerate(root))) == groups(slow_components(sets))


def test_stage_keeps_one_row_of_each_component(spark, odd, nothing):
    kept = nearcopies.near_duplicate_stage(odd)
    assert kept.dtypes == odd.dtypes
    ids = sorted(str(r.doc_id) for r in kept.collect())
    found = nearcopies.near_components(odd).collect()
    least = {}
    for r in found:
        key = (r.doc_id is None, r.doc_id or 0)
        least[r.component] = min(least.get(r.component, key), key)
    assert ids == sorted(str(None if last else d) for last, d in least.values())
    assert nearcopies.near_duplicate_stage(nothing).count() == 0
    rows = [(7, "a b c d e f g"), (7, "a b c d e f g"), (7, "other words are in this text here"), (None, "x"), (None, "x"), (8, "A b c d e f g")]
    got = nearcopies.near_duplicate_stage(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(7, "a b c d e f g"), (7, "other words are in this text here"), (None, "x")]))
