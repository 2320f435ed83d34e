import random
from collections import defaultdict

from spanwright.llm import suffixes


def slow(rows, least=50):
    """Words of each row that are in a window of `least` words that another row has too."""
    has = defaultdict(set)
    words = [(r.text or "").encode().split() for r in rows]
    for k, w in enumerate(words):
        for i in range(len(w) - least + 1):
            has[tuple(w[i : i + least])].add(k)
    out = []
    for k, w in enumerate(words):
        covered = set()
        for i in range(len(w) - least + 1):
            if len(has[tuple(w[i : i + least])]) > 1:
                covered |= set(range(i, i + least))
        out.append((rows[k].doc_id, covered))
    return out


def covered(df):
    got = defaultdict(set)
    for r in df.collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    return got


def make(spark, seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = [fresh(rng.choice([49, 50, 51, 70, 130])) for _ in range(8)]
    rows = []
    for k in range(60):
        text = fresh(rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 3)):
            text += rng.choice(shared) + fresh(rng.randrange(0, 60))
        rows.append((k, " ".join(text)))
    rows += [(100, rows[3][1]), (101, " ".join(["a b c d"] * 40)), (102, None), (103, ""), (104, " ".join(fresh(60)))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_equals_brute_force(spark):
    for seed in (1, 2):
        df = make(spark, seed)
        want = {d: c for d, c in slow(df.collect()) if c}
        assert dict(covered(suffixes.passages(df))) == want


def crowd(spark, seed):
    """Short phrases that most texts share, around which some pairs of texts share 50 words and more."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    phrases = [fresh(rng.choice([10, 14, 30, 45])) for _ in range(3)]
    rows = []
    for k in range(80):
        text = fresh(rng.randrange(0, 40))
        for _ in range(3):
            text += rng.choice(phrases) + fresh(rng.randrange(0, 45))
        rows.append(text)
    for _ in range(12):
        a, b = rng.sample(range(80), 2)
        at = rng.randrange(0, max(1, len(rows[a]) - 60))
        rows[b] = rows[b] + fresh(3) + rows[a][at : at + rng.choice([49, 50, 55, 60])] + fresh(30)
    return spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(rows)], "doc_id long, text string").repartition(3)


def test_no_match_is_missed_in_a_crowd(spark):
    for seed in range(4):
        df = crowd(spark, seed)
        want = {d: c for d, c in slow(df.collect()) if c}
        assert dict(covered(suffixes.passages(df))) == want
        assert dict(covered(suffixes.passages(df, near=1))) == want


def test_a_third_text_far_from_a_found_pair(spark):
    """Two texts agree around a crowded phrase; a third, sorted elsewhere, shares only the words before and the phrase."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for _ in range(12):
        phrase, before, after = fresh(28), fresh(30), fresh(42)
        rows += [fresh(20) + before + phrase + after + fresh(20) for _ in range(2)]
        rows += [fresh(20) + before + phrase + fresh(60)]
        # start from one partner, end from another
        rows += [fresh(40) + before[-22:] + phrase + fresh(60), fresh(60) + phrase + after[:22] + fresh(40)]
        rows += [fresh(30) + phrase + fresh(30) for _ in range(30)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    want = {d: c for d, c in slow(df.collect()) if c}
    for near in (1, 4):
        assert dict(covered(suffixes.passages(df, near=near))) == want


def test_odd_rows(odd, nothing):
    rows = odd.collect()
    want = slow(rows)
    got = covered(suffixes.passages(odd))
    ids = [r.doc_id for r in rows]
    for doc, own in want:
        if ids.count(doc) == 1:
            assert got.get(doc, set()) == own, doc
    assert suffixes.passages(nothing).count() == 0
