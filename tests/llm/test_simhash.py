import random
import re

import numpy as np
import xxhash

from spanwright.llm import simhash


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, distance=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_equals_brute_force(odd):
    rows = odd.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    want = sorted(map(str, zip([r.doc_id for r in rows], [np.uint64(f).astype(np.int64).item() for f in fps], slow_components([r.doc_id for r in rows], fps), strict=True)))
    assert sorted(str((r.doc_id, r.fp, r.component_id)) for r in simhash.simhash_components(odd).collect()) == want


def test_hot_buckets_are_split_without_losing_a_link(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    df = spark.createDataFrame([(np.uint64(f).astype(np.int64).item(),) for f in fps], "fp long")
    from spanwright.llm.graph import connected_components

    got = {r.node: r.root for r in connected_components(simhash.links(df, bucket=8)).collect()}
    ids = [np.uint64(f).astype(np.int64).item() for f in fps]
    assert [got.get(x, x) for x in ids] == slow_components(ids, fps)


def test_no_documents(nothing):
    assert simhash.simhash_components(nothing).count() == 0
