"""Windows of entries by filter and verification, against all pairs."""

import random
from itertools import accumulate

from pyspark.sql import functions as F

from spanwright.operators import search, windows

ENTRY = "no long, text string"


def slow_windows(entries, n):
    ends = [0, *accumulate(len(t.split()) for t in entries)]
    return [(i, j, " ".join(entries[i : j + 1])) for i in range(len(entries)) for j in range(i, len(entries)) if ends[j + 1] - ends[i] == n]


def slow_match(text, entries):
    text = " ".join(text.split())
    n = len(text.split())
    for size, score, least in [(n, search.ratio, 75), *((k, search.partial_ratio, 90) for k in (12, 8, 5, 3, 2, 1))]:
        found = [(score(text, w), -i, j) for i, j, w in slow_windows(entries, size)]
        if found and max(found)[0] >= least:
            s, i, j = max(found)
            return size, -i, j, round(s / 100, 6)
    return None


def garbled(rng, text, share):
    return "".join("" if (x := rng.random()) < share / 2 else rng.choice("abcdefgh ") if x < share else c for c in text)


def test_matches_equal_all_pairs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 5, 8])))
    entries = [" ".join(word() for _ in range(rng.choice([1, 1, 2, 3, 4, 7]))) for _ in range(60)]
    texts = ["", "   ", "zz yy xx", "a", entries[3], entries[3]]
    for _ in range(160):
        i = rng.randrange(55)
        texts.append(garbled(rng, " ".join(entries[i : i + rng.randrange(1, 5)]), rng.choice([0, 0.05, 0.15, 0.3])))
    df = spark.createDataFrame([*enumerate(texts), (999, None)], "doc long, text string")
    got = {r.doc: (r.words, r["first"], r["last"], r.score) for r in windows.tight_windows(df, spark.createDataFrame(list(enumerate(entries)), ENTRY), "doc", "no").collect()}
    want = {k: m for k, t in enumerate(texts) if t.strip() and (m := slow_match(t, entries))}
    assert got == want
    assert len({m[0] for m in want.values()}) > 5 and len(want) > 100


def test_no_pair_above_the_share_is_lost(spark):
    """All pairs of random strings of every small length: what is alike enough meets."""
    rng = random.Random(4)
    some = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 16))) for _ in range(220)]
    a = spark.createDataFrame([(k, t, 1) for k, t in enumerate(some[:110])], "a long, text string, n long")
    b = spark.createDataFrame([(k, t, 1) for k, t in enumerate(some[110:])], "b long, text string, n long")
    for pairs, score, least in ((windows.whole_pairs(a, b), search.ratio, 75), (windows.part_pairs(a, b), search.partial_ratio, 90)):
        got = sorted((r.a, r.b) for r in pairs.collect())
        assert got == sorted((i, j) for i, x in enumerate(some[:110]) for j, y in enumerate(some[110:]) if score(x, y) >= least)
        assert len(got) > 300


def test_the_filter_keeps_most_pairs_apart(spark):
    rng = random.Random(6)
    some = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)) for _ in range(400)]
    a = spark.createDataFrame([(k, t, 1) for k, t in enumerate(some[:200])], "a long, text string, n long")
    b = spark.createDataFrame([(k, t, 1) for k, t in enumerate(some[200:])], "b long, text string, n long")
    met = windows.sharing_pairs(a, b, ["n"], F.lit(3), F.lit(16)).count()
    assert met < 0.1 * 200 * 200


def test_entry_windows(spark):
    entries = ["a b", "", "c", "d e f", "g"]
    df = spark.createDataFrame([(10 * k, t) for k, t in enumerate(entries)] + [(99, None)], ENTRY)
    counts = spark.createDataFrame([(3,), (4,), (50,)], "n long")
    got = sorted((r.n, r["first"], r["last"], r.window) for r in windows.entry_windows(df, "no", counts).collect())
    assert got == [(3, 0, 20, "a b c"), (3, 30, 30, "d e f"), (4, 20, 30, "c d e f"), (4, 30, 40, "d e f g")]
    assert windows.entry_windows(df.limit(0), "no", counts).count() == 0
