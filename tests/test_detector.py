"""Passages of a canon in transcripts, against literal loops."""

import random

import pytest
from pyspark.sql import functions as F

from spanwright.functions import text
from spanwright.operators import detector

CLAIM = "doc_id long, item_id long, doc_from int, doc_to int, canon_from int, canon_to int, matched long, score double"


def slow_fragments(doc, item):
    at = {(i, j) for i in range(len(doc) - 1) for j in range(len(item) - 1) if doc[i : i + 2] == item[j : j + 2]}
    out = []
    for i, j in at:
        if (i - 1, j - 1) in at:
            continue
        n = 0
        while (i + n, j + n) in at:
            n += 1
        out.append((i, i + n + 1, j, j + n + 1))
    return sorted(out)


def slow_chains(fragments, least=4, score=0.55):
    runs = []
    for a, b, c, d in sorted(fragments, key=lambda f: (f[0], f[2], f[1], f[3])):
        last = runs[-1] if runs else None
        room = 25 if last and last[4] >= 20 else 6
        if last and 0 <= a - last[1] <= 25 and 0 <= c - last[3] < room:
            runs[-1] = (last[0], b, last[2], d, last[4] + b - a)
        else:
            runs.append((a, b, c, d, b - a))
    return [r for r in runs if r[4] >= least and round(min(1, r[4] / (r[3] - r[2])), 6) >= score]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


PLACES = ("doc_id", "item_id", "doc_from", "doc_to", "canon_from", "canon_to")


def test_fragments_and_chains_equal_loops(spark):
    rng = random.Random(1)
    canon = [[rng.choice("abcdefghijklmnop") for _ in range(60)] for _ in range(4)]
    docs = []
    for k in range(12):
        item = canon[k % 4]
        text = item[rng.randrange(20) :][:40]
        for _ in range(k):
            i = rng.randrange(len(text))
            text[i : i + rng.randrange(2)] = [rng.choice("xyz")] * rng.randrange(3)
        docs.append(text)
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(docs)] + [(90, None), (91, ""), (92, "a")], "doc_id long, text string")
    c = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(canon)], "item_id long, text string")
    found = detector.fragments(d, c, "doc_id", "item_id", 10_000)
    want = [(i, j, *f) for i, doc in enumerate(docs) for j, item in enumerate(canon) for f in slow_fragments(doc, item)]
    assert rows(found, *PLACES) == sorted(want)
    want = [(i, j, *r) for i, doc in enumerate(docs) for j, item in enumerate(canon) for r in slow_chains(slow_fragments(doc, item))]
    assert rows(detector.chain_runs(found, "doc_id", "item_id"), *PLACES, "matched") == sorted(want)
    assert detector.chain_runs(found.limit(0), "doc_id", "item_id").count() == 0


def test_common_pairs_are_no_anchors(spark):
    c = spark.createDataFrame([(k, "of the " + f"w{k} v{k}") for k in range(5)], "item_id long, text string")
    d = spark.createDataFrame([(1, "of the w3 v3")], "doc_id long, text string")
    assert rows(detector.fragments(d, c, "doc_id", "item_id", 3), *PLACES) == [(1, 3, 1, 4, 1, 4)]


def test_claims_count_pairs_however_common(spark):
    """A pair that the canon has more than COMMON times is part of a claim; `fragments` alone leaves it out."""
    c = spark.createDataFrame([(k, f"of the w{k} v{k}") for k in range(detector.COMMON + 20)], "item_id long, text string")
    d = spark.createDataFrame([(1, "um of the w3 v3"), (2, "of the of the")], "doc_id long, text string")
    assert rows(detector.detect(d, c), *PLACES, "matched") == [(1, 3, 1, 5, 0, 4, 4)]
    assert rows(detector.fragments(d, c, "doc_id", "item_id"), *PLACES) == [(1, 3, 2, 5, 1, 4)]


def numbers(a, b, name="w"):
    return " ".join(f"{name}{k}" for k in range(a, b))


def test_every_repeat_is_found(spark):
    c = spark.createDataFrame([(1, numbers(0, 40)), (2, numbers(0, 30, "v"))], "item_id long, text string")
    text = " ".join([numbers(5, 17), "um", numbers(5, 17), numbers(5, 14), "er", numbers(5, 8)])
    d = spark.createDataFrame([(1, text), (2, numbers(3, 25, "v"))], "doc_id long, text string")
    got = rows(detector.detect(d, c), "doc_id", "item_id", "doc_from", "doc_to", "canon_from", "canon_to")
    assert got == [(1, 1, 0, 12, 5, 17), (1, 1, 13, 25, 5, 17), (1, 1, 25, 34, 5, 14), (2, 2, 0, 22, 3, 25)]


def test_settled_runs_may_leap_further(spark):
    c = spark.createDataFrame([(1, numbers(0, 80))], "item_id long, text string")
    d = spark.createDataFrame([(1, numbers(0, 10) + " " + numbers(20, 30)), (2, numbers(0, 25) + " " + numbers(40, 50))], "doc_id long, text string")
    got = rows(detector.chain_runs(detector.fragments(d, c, "doc_id", "item_id"), "doc_id", "item_id"), "doc_id", "canon_from", "canon_to")
    assert got == [(1, 0, 10), (1, 20, 30), (2, 0, 50)]


def slow_settle(claims):
    total = {}
    for c in claims:
        total[c[0], c[1]] = total.get((c[0], c[1]), 0) + c[6]
    kept = []
    for c in sorted(claims, key=lambda c: (-total[c[0], c[1]], -c[7], c[1], c[2], c[3], c[4])):
        rival = [k for k in kept if k[0] == c[0] and k[1] != c[1] and min(k[3], c[3]) - max(k[2], c[2]) >= max(1, 0.5 * min(k[3] - k[2], c[3] - c[2]))]
        if not rival:
            kept.append(c)
    return sorted(kept)


@pytest.mark.parametrize("seed", range(3))
def test_rivals_are_settled_in_order(spark, seed):
    rng = random.Random(seed)
    claims = set()
    for _ in range(60):
        a, n = rng.randrange(60), rng.randrange(4, 25)
        claims.add((rng.randrange(3), rng.randrange(4), a, a + n, rng.randrange(50), 90, n, rng.choice([0.6, 0.8, 1.0])))
    df = spark.createDataFrame(sorted(claims), CLAIM)
    got = sorted(tuple(r) for r in detector.settle(df, "doc_id", "item_id").collect())
    assert got == slow_settle(list(claims)) and len(got) < len(claims)
    assert detector.settle(df.limit(0), "doc_id", "item_id").count() == 0


def test_hits_are_dealt_over_more_tasks_than_the_input_has(spark):
    docs = spark.createDataFrame([(k, "a b c d") for k in range(40)], "doc_id long, text string").repartition(12)
    canon = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    plan = detector.chain_runs(detector.fragments(docs, canon, "doc_id", "item_id"), "doc_id", "item_id")._jdf.queryExecution().toString()
    assert "hashpartitioning(doc_id" in plan and f", {12 * detector.PARTS})" in plan


def test_words_of_transcripts_are_worked_out_once(spark):
    rows = spark.createDataFrame([(1, "and of the of the end of"), (2, "of of the the"), (3, None), (4, "of the"), (5, "one"), (6, "That and ofَ the x y")], "doc_id long, text string")
    own = text.without_openings(text.words(F.col("text")), {"first": ["That", "and"]}, ["of", "the"])
    docs = rows.select("doc_id", own.alias("w"))
    assert {r.doc_id: list(r.w) for r in docs.collect()} == {1: ["and", "end", "of"], 2: ["of", "the"], 3: [], 4: [], 5: ["one"], 6: ["x", "y"]}
    found = detector.pairs(docs, "doc_id", "at")
    assert sorted(map(tuple, found.collect())) == [(1, 0, "and end"), (1, 1, "end of"), (2, 0, "of the"), (6, 0, "x y")]
    for df in (found, detector.pairs(rows, "doc_id", "at")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
