"""Whole transcripts beside a canon, against the operators that deal matches over tasks."""

import random

import numpy as np

from spanwright.operators import chains, search, transcripts

from test_chains import CANON, DOC, garbled


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_chains_without_a_shuffle_of_matches(spark):
    rng = random.Random(4)
    word = lambda k: rng.choice([f"c{rng.randrange(4)}", f"r{rng.randrange(40)}", f"u{k}", "يَـٰٓأَيُّهَا", "ٱلصَّلَوٰةَ"])
    canon = [(k, " ".join(word(k) for _ in range(40))) for k in range(5)]
    docs = [(k, garbled(rng, canon)) for k in range(30)] + [(40 + k, "r1 يا ايها الصلاة " * k + canon[k][1]) for k in range(4)] + [(90, None), (91, ""), (92, "zz")]
    docs, canon = spark.createDataFrame(docs, DOC), spark.createDataFrame(canon, CANON)
    index = chains.flat_canon(canon, "item_id").cache()
    for first, common in ((None, 100), (5, 6)):
        points = chains.near_seeds(chains.heard_words(docs, "doc_id", index), index, "doc_id", first, common)
        want = rows(chains.best_chains(points, "doc_id"))
        got = chains.chain_matches(docs, index, "doc_id", "item_id", first, common)
        assert rows(got.select("doc_id", "t", "at", "p")) == want and len({r[0] for r in want}) > 10
    told = chains.ranked(chains.heard_words(docs, "doc_id", index), "doc_id").cache()
    assert rows(chains.opening_chapters(docs, index, "doc_id", "item_id")) == rows(chains.chapter_candidates(told, index, "doc_id", "item_id"))
    assert rows(chains.long_runs(docs, index, "doc_id", "item_id", 30)) == rows(chains.lane_runs(told.filter("words >= 30"), index, "doc_id", "item_id")[1].drop("lane", "run"))


def test_columns_and_rows_align_alike(monkeypatch):
    rng = random.Random(1)
    for _ in range(300):
        of = rng.choice([2, 4, 12])
        heard = [f"w{rng.randrange(of)}" for _ in range(rng.randrange(8, 50))]
        canon = [[f"w{rng.randrange(of)}" for _ in range(rng.randrange(1, 3))] for _ in range(rng.randrange(25))]
        weight = {f"w{k}": 1 / (1 + rng.randrange(1, 5)) for k in range(of)}
        columns = search.align_pair(heard, canon, weight)
        with monkeypatch.context() as m:
            m.setattr(search, "CELLS", -1)
            assert search.align_pair(heard, canon, weight) == columns


def test_stretches_take_their_places_in_step(monkeypatch):
    entries = [{"item": k // 50, "pos": k % 50, "p": k, "form": f"w{k}", "split": False} for k in range(2000)]
    canon, calls, step = transcripts.Canon(entries, 100), [], transcripts.Canon._step
    monkeypatch.setattr(transcripts.Canon, "_step", lambda *a: calls.append(a[1:3]) or step(*a))
    told = [np.arange(k, k + 12) for k in range(0, 1900, 20)]
    chains = canon.chains(told, 40, 25, 3)
    assert chains == {k: [(t, 20 * k + t) for t in range(12)] for k in range(len(told))}
    assert len(calls) == 12


def test_many_pairs_align_as_each_of_them(monkeypatch):
    rng = random.Random(2)
    gain = 1 / (1 + np.arange(1, 7))
    pairs = [(np.array([rng.randrange(6) for _ in range(rng.randrange(10, 60))]), np.array([[rng.randrange(6), rng.choice([-1, 3])] for _ in range(rng.randrange(1, 30))])) for _ in range(200)]
    monkeypatch.setattr(search, "TOGETHER", 20_000)
    together = search.align_columns(pairs, gain)
    monkeypatch.setattr(search, "CELLS", -1)
    for (h, c), found in zip(pairs, together, strict=True):
        assert search.align_pair([str(x) for x in h], [[str(y) for y in x if y >= 0] for x in c], {str(k): g for k, g in enumerate(gain)}) == found
