"""Chunks placed by a cursor, against a walk through each clip."""

import random

import pytest
from pyspark.sql import functions as F

from spanwright.operators import cursor, search

CHUNK = "clip long, k int, w array<string>, canon array<string>, verses array<int>, start_ms long, end_ms long"


def walk(chunks, canon):
    at, out = 0, {}
    for k, w in chunks:
        if not w or not canon:
            continue
        scores = {p: search.ratio(" ".join(w), " ".join(canon[p : p + len(w)])) for p in range(at, min(len(canon), at + max(len(w) + 2, 8)))}
        best = max(scores, key=lambda p: (scores[p], -p), default=None)
        if best is not None and scores[best] >= 55:
            out[k] = best, min(best + len(w), len(canon))
            at = max(at, out[k][1])
    return out


def clip(rng, n):
    canon = ["".join(rng.choice("abcdeo") for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(1, 60))]
    chunks, at = [], 0
    for k in range(n):
        size = rng.randrange(0, 7)
        w = [x if rng.random() > 0.2 else x[:-1] + "z" for x in canon[at : at + size]] if rng.random() > 0.2 else ["qq", "vv"][: rng.randrange(3)]
        chunks.append((k, w))
        at = (at + size + rng.randrange(-1, 3)) % len(canon)
    return canon, chunks


@pytest.fixture(scope="module")
def clips(spark):
    rng = random.Random(3)
    return {c: clip(rng, rng.choice([1, 2, 5, 9, 33])) for c in range(25)}


@pytest.fixture(scope="module")
def rows(spark, clips):
    own = [(c, k, w, canon, [p // 5 for p in range(len(canon))], 1000 * k, 1000 * k + 900) for c, (canon, chunks) in clips.items() for k, w in chunks]
    return spark.createDataFrame([*own, (90, 0, ["a"], [], [], 0, 1), (91, 0, None, None, None, 0, 1)], CHUNK).repartition(3)


def test_places_equal_a_walk(rows, clips):
    got = {(r.clip, r.k): (r["first"], r["last"]) for r in cursor.placed_chunks(rows, "clip", "k").collect()}
    want = {(c, k): p for c, (canon, chunks) in clips.items() for k, p in walk(chunks, canon).items()}
    assert got == want
    assert len(want) > 50


def test_segments_take_the_verse_of_most_words(rows, clips):
    want = {}
    for c, (canon, chunks) in clips.items():
        for k, (a, b) in walk(chunks, canon).items():
            own = [p // 5 for p in range(a, b)]
            verse = max(sorted(set(own)), key=own.count)
            start = want.get((c, verse), (1000 * k,))[0]
            want[c, verse] = start, 1000 * k + 900
    got = {(r.clip, r.verse): (r.start_ms, r.end_ms) for r in cursor.passage_segments(rows, "clip", "k").collect()}
    assert got == want
    assert cursor.passage_segments(rows.limit(0), "clip", "k").count() == 0


def test_maps_are_composed_in_order(spark):
    rng = random.Random(1)
    maps = {(c, k): [rng.randrange(6) for _ in range(6)] for c, n in ((1, 1), (2, 17), (3, 8)) for k in range(n)}
    df = spark.createDataFrame([(*x, m) for x, m in maps.items()], "c int, k int, m array<int>")
    got = {(r.c, r.k): list(r.m) for r in cursor.composed(df, "c", "k", "m").collect()}
    for (c, k), found in got.items():
        own = list(range(6))
        for j in range(k + 1):
            own = [maps[c, j][s] for s in own]
        assert found == own
    assert len(got) == len(maps)


def test_a_shared_table_gives_the_same_similarities(spark):
    rng = random.Random(2)
    some = ["".join(rng.choice("abc é") for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    for a in some[:10]:
        for b, x in zip(some, search.ratios(a, some), strict=True):
            table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, c in enumerate(a):
                for j, d in enumerate(b):
                    table[i + 1][j + 1] = table[i][j] + 1 if c == d else max(table[i][j + 1], table[i + 1][j])
            assert x == (200.0 * table[-1][-1] / (len(a) + len(b)) if a or b else 100.0)
            assert x == search.ratio(a, b)


def test_chunks_are_compared_about_their_cursor_alone(spark, monkeypatch):
    rng = random.Random(5)
    canon, chunks = clip(rng, 40)
    want = walk(chunks, canon)
    rows = spark.createDataFrame([(1, k, w, canon, [p // 5 for p in range(len(canon))], 1000 * k, 1000 * k + 900) for k, w in chunks], CHUNK)
    staged = []
    monkeypatch.setattr(cursor, "staged", lambda df, name: staged.append(name) or df)
    assert {r.k: (r["first"], r["last"]) for r in cursor.placed_chunks(rows, "clip", "k", "verses").collect()} == want
    # no rounds of maps over the whole clip
    assert staged == []
