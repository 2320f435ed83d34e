"""From words to captions, against literal loops."""

import random

from spanwright.operators import assembly, search

SPAN = "clip_id long, group long, start_ms long, end_ms long"


def test_places_of_words(spark):
    canon = "alpha beta gamma beta delta epsilon".split()
    heard = ["alpha", "beta", "gamma", "beta", "beta", "delta", "epsilo", "zzz", "alpha", ""]
    words = spark.createDataFrame([(1, k, w) for k, w in enumerate(heard)] + [(2, 0, "alpha")], "clip_id long, idx long, word string")
    texts = spark.createDataFrame([(1, canon)], "clip_id long, canon array<string>")
    got = {(r.clip_id, r.idx): r.place for r in assembly.canon_places(words, texts, ["clip_id"]).collect()}
    assert [got[1, k] for k in range(10)] == [0, 1, 2, 3, 3, 4, 5, None, 0, None] and got[2, 0] is None


def slow_places(heard, canon):
    pos, out = 0, []
    for w in heard:
        at = [j for j, c in enumerate(canon) if c == w]
        near = [(-search.ratio(w, c), j) for j, c in enumerate(canon) if pos - 10 <= j < pos + 10 and search.ratio(w, c) >= 78]
        place = min(at, key=lambda j: (abs(j - pos), j < pos)) if w and at else min(near)[1] if w and near else None
        pos = pos if place is None else place + 1
        out.append(place)
    return out


def test_long_passages_take_a_pass(spark):
    rng = random.Random(5)
    some = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    texts = [[rng.choice(some) for _ in range(rng.randrange(1, 80))] for _ in range(40)]
    heard = [[w if rng.random() < 0.6 else w[:-1] if rng.random() < 0.5 else rng.choice(some) for w in canon] for canon in texts]
    # some 20,000 words in one passage: an array that is copied for each word doesn't get there
    texts.append([f"w{k}" for k in range(20_000)])
    heard.append([f"w{k}" if k % 50 else f"w{k}x" for k in range(20_000)])
    words = spark.createDataFrame([(c, k, w) for c, own in enumerate(heard) for k, w in enumerate(own)], "clip_id long, idx long, word string")
    rows = assembly.canon_places(words, spark.createDataFrame(list(enumerate(texts)), "clip_id long, canon array<string>"), ["clip_id"]).collect()
    got = {(r.clip_id, r.idx): r.place for r in rows}
    for c in range(40):
        assert [got[c, k] for k in range(len(heard[c]))] == slow_places(heard[c], texts[c])
    assert [got[40, k] for k in range(1, 20_000) if k % 50] == [k for k in range(1, 20_000) if k % 50]


def test_partial_ratio():
    assert search.partial_ratio("abc", "xxabcxx") == 100 and search.partial_ratio("", "") == 100 and search.partial_ratio("", "a") == 0
    assert search.partial_ratio("abcd", "abxd") == search.ratio("abcd", "abxd") == 75


def slow_holes(words, groups, forms):
    out, left = {}, []
    for c, i, s, e, w in words:
        inside = [g for k, g, a, b in groups if k == c and a - 50 <= s and e <= b + 50]
        if inside:
            out[c, i] = min(inside)
        else:
            left.append((c, i, s, w))
    order = sorted(groups)
    holes = {}
    for c, i, s, w in left:
        for x, y in zip(order, order[1:], strict=False):
            if x[0] == y[0] == c and y[2] - x[3] > 50 and x[3] - 50 <= s < y[2] + 50:
                holes.setdefault((c, x[1], y[1]), []).append((i, w))
                break
    for (c, a, b), own in holes.items():
        hit = lambda g: sum((c, g, w) in forms for _, w in own)  # noqa: B023, E731
        to = b if hit(b) >= hit(a) and 2 * hit(b) >= len(own) else a
        out |= {(c, i): to for i, _ in own}
    return out


def test_holes_are_closed(spark):
    rng = random.Random(3)
    groups, forms, words = [], set(), []
    for c in range(4):
        t = 0
        for g in range(8):
            t += rng.randrange(0, 600)
            groups.append((c, g, t, t + 300))
            t += 300
            forms |= {(c, g, w) for w in rng.sample("abcdefgh", 3)}
        words += [(c, 100 * c + k, s, s + rng.randrange(80), rng.choice("abcdefgh")) for k, s in enumerate(rng.randrange(t + 300) for _ in range(60))]
    got = assembly.close_holes(
        spark.createDataFrame(words, "clip_id long, idx long, start_ms long, end_ms long, word string"), spark.createDataFrame(groups, SPAN), spark.createDataFrame(sorted(forms), "clip_id long, group long, word string")
    )
    assert {(r.clip_id, r.idx): r.group for r in got.collect()} == slow_holes(words, groups, forms)
