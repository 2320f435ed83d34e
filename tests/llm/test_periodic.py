import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from spanwright.llm import periodic


def brute_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and not any(w[i + p : j + q] == w[i : j + q - p] for p in range(1, q)):
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def odd_words(rng):
    alphabet = rng.choice([1, 2, 2, 3, 5])
    out = []
    while len(out) < rng.randrange(1, 150):
        part = [b"%d" % rng.randrange(alphabet + 1) for _ in range(rng.randrange(1, 12))]
        out += (part * rng.randrange(1, 9))[: rng.randrange(1, 100)]
    if rng.random() < 0.3:
        out *= rng.randrange(1, 6)
    if rng.random() < 0.3:  # periods within periods
        out = out[:9] + (([b"a"] * rng.randrange(1, 9) + [b"b"]) * rng.randrange(1, 7) + [b"c"]) * rng.randrange(1, 7) + out[9:30]
    return out


def test_runs_equal_brute_force():
    rng, total = random.Random(7), 0
    for _ in range(150):
        texts = [odd_words(rng) if rng.random() > 0.1 else [] for _ in range(rng.randrange(1, 10))]
        for w, runs in zip(texts, periodic.batch_runs(texts), strict=True):
            assert [tuple(r) for r in runs.tolist()] == brute_runs(w)
            total += len(runs)
    assert total > 1500


def test_long_periods_and_sets_stay_sparse():
    rng = random.Random(2)
    part = [b"%d" % rng.randrange(9) for _ in range(1777)]
    text = [b"x"] * 5000 + part * 4 + part[:100] + [b"y"] * 6
    (runs,) = periodic.batch_runs([text])
    assert {tuple(r) for r in runs.tolist()} >= {(0, 5000, 1), (5000, 4 * 1777 + 100, 1777), (5000 + 4 * 1777 + 100, 6, 1)}
    ids = periodic._mix(np.zeros(4096, np.uint64), 0)
    assert len(periodic._synchronising(ids, np.ones(len(ids), bool), 16)) == 0  # a periodic region chooses nothing
    other = periodic._mix(np.arange(4096, dtype=np.uint64), 0)
    assert len(periodic._synchronising(other, np.zeros(len(other), bool), 64)) < 4 * 4096 / 64


def test_colliding_hashes_are_done_again(monkeypatch):
    true, seeds = periodic._mix, []

    def coarse(x, seed):
        seeds.append(seed)
        return true(x, seed) & np.uint64(3 if seed < 2 else (1 << 64) - 1)

    monkeypatch.setattr(periodic, "_mix", coarse)
    rng = random.Random(3)
    text = [b"%d" % rng.randrange(40) for _ in range(400)] + [b"a", b"b", b"c"] * 9
    (runs,) = periodic.batch_runs([text])
    assert [tuple(r) for r in runs.tolist()] == brute_runs(text)
    assert max(seeds) >= 2


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_odd_documents(odd, nothing):
    rows = odd.select("doc_id", "text").collect()
    got = periodic.periodic_runs(odd).collect()
    assert periodic.periodic_runs(nothing).count() == 0
    want = []
    for r in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", r.text or "") if x]
        runs = brute_runs(w) if len(w) < 2000 else [(0, len(w), 1)]
        want.append((r.doc_id, len(w), runs, collapsed(w, runs)))
    assert sorted(want, key=repr) == sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr)


def test_known_periods(spark):
    texts = {k: " ".join(f"w{i * k % 97}" for i in range(k % 60)) for k in range(400)}
    df = spark.createDataFrame([*texts.items(), (None, "a b")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in periodic.with_periods(df).collect()}
    changed = 0
    for k, text in texts.items():
        h, w = zlib.crc32(str(k).encode()), text.split()
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(w[:a] + [w[a + (i - a) % p] for i in range(a, n)])
            changed += 1
        assert got[k] == text
    assert changed > 20 and got[None] == "a b"


def test_longest_run_breaks_ties(spark):
    df = spark.sql("SELECT array(named_struct('start', 9L, 'length', 8L, 'period', 2L), named_struct('start', 3L, 'length', 8L, 'period', 2L), named_struct('start', 3L, 'length', 8L, 'period', 1L)) AS runs, array() AS none")
    row = df.select(periodic.longest_run(F.col("runs")).alias("best")).first()
    assert (row.best.start, row.best.period) == (3, 1)


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 9])
def test_window_min(width):
    x = np.random.default_rng(width).integers(0, 50, 40)
    assert periodic._window_min(x, width).tolist() == [min(x[i : i + width]) for i in range(41 - width)]
