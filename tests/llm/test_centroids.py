import hashlib
import math

import numpy as np
import pytest
from spanwright.llm import centroids


@pytest.mark.parametrize("seed", range(40))
def test_tree_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    limit, dims = int(rng.choice([1, 3, 100, 10**6])), int(rng.integers(1, 6))
    centres, points = rng.integers(-limit, limit + 1, (int(rng.integers(1, 60)), dims)), rng.integers(-limit, limit + 1, (150, dims))
    label, far = centroids.nearest(centroids.vantage_tree(centres), centres, points)
    every = ((points[:, None] - centres[None]) ** 2).sum(2)
    assert label.tolist() == every.argmin(1).tolist() and far.tolist() == every.min(1).tolist()


def test_most_nodes_stay_closed():
    rng = np.random.default_rng(1)
    centres = np.concatenate([rng.integers(-9, 10, (20, 8)) + 1000 * k for k in range(8)])
    nodes, opened = centroids.vantage_tree(centres), []

    class Watched(list):
        def __getitem__(self, k):
            opened.append(k)
            return super().__getitem__(k)

    label, _ = centroids.nearest(Watched(nodes), centres, centres[:1] + 1)
    assert label[0] < 20 and len(set(opened)) < len(nodes) / 3


def brute(rows, k, rounds, dims):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dims and all(c is not None and math.isfinite(c) for c in x):
            kept.append((vec_id, tuple(max(-(1 << 27), min(1 << 27, math.floor(256 * max(-(2.0**27), min(2.0**27, c))))) for c in x)))
    seeds = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [v for _, v in seeds]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(cents))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        cents = [tuple(sum(c) // len(own[i]) for c in zip(*own[i], strict=True)) if i in own else old for i, old in enumerate(cents)]
    out = [(vec_id, *near(v)[::-1]) for vec_id, v in kept]
    inertia = {i: sum(d for _, c, d in out if c == i) for i in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(vec_id, c, d, inertia[c], sum(inertia.values()), sha[c]) for vec_id, c, d in out]


def test_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.1, 64)]) for i in rng.integers(0, 90, 120)]
    rows += [(200 + i, list(rows[0][1])) for i in range(60)]  # one common vector
    rows += [(300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 63 + [None]), (304, [0.5] * 63 + [float("nan")]), (305, [0.5] * 63 + [float("-inf")])]
    rows += [(None, [0.25] * 64), (306, [3e38] * 64), (307, [-3e38] * 64)]
    rows.append(rows[1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "'clash' AS cluster", "2 AS distance").repartition(4)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    floats = [(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, x in rows]
    want = [(a, b, c, d if d < 1 << 63 else None, e if e < 1 << 63 else None, f) for a, b, c, d, e, f in brute(floats, 40, 5, 64)]
    assert sorted(map(tuple, centroids.op12(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_empty_and_few(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.0] * 64), (2, [1.0] * 64)], "vec_id long, embedding array<float>")
    df.limit(0).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    df.write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert centroids.op12(spark, f"{tmp_path}/a").count() == 0
    assert {tuple(r)[1:5] for r in centroids.op12(spark, f"{tmp_path}/b").collect()} == {(0, 0, 0, 0), (1, 0, 0, 0)}
