"""Anchor chains against a quadratic search over the same matches, and known cases."""

import random

from spanwright.operators import chains

DOC, CANON = "doc_id long, text string", "item_id long, text string"


def numbers(a, b, name="w"):
    return " ".join(f"{name}{k}" for k in range(a, b))


def slow_points(heard, flat, first, common, reach):
    count = {}
    for w in flat:
        count[w] = count.get(w, 0) + 1
    heard = [(at, w) for at, w in heard if w in count]
    every = [(t, at, p, count[w]) for t, (at, w) in enumerate(heard) for p, x in enumerate(flat) if x == w]
    places = {(t, p): n for t, _, p, n in every}
    seeds = [(t, p) for (t, p), n in places.items() if (t + 1, p + 1) in places and min(n, places[t + 1, p + 1]) <= common]
    near = [x for x in every if any(abs(x[0] - t) <= reach and abs(x[2] - p) <= reach for t, p in seeds)]
    return [(t, at, p, n <= common and (first is None or t < first)) for t, at, p, n in near]


def slow_chain(points, reach=25, least=3):
    """Every end's best chain, without and with an anchor, over all matches before it."""
    best = {}
    for t, at, p, anchor in sorted(points, key=lambda x: (x[2], x[0])):
        def before(flag):
            found = []
            for (t2, p2, f2), (adjacent, n, _) in best.items():
                if f2 == flag and t2 < t and p - reach <= p2 < p:
                    found.append((adjacent + (p2 == p - 1), n + 1, p2, t2, flag))
            return max(found, default=None)

        plain, anchored = before(0), before(1)
        if anchor:
            pick = max([x for x in (plain, anchored) if x], default=None)
            best[t, p, 1] = (pick[0], pick[1], (pick[3], pick[2], pick[4])) if pick else (0, 1, None)
        else:
            best[t, p, 0] = (plain[0], plain[1], (plain[3], plain[2], 0)) if plain else (0, 1, None)
            if anchored:
                best[t, p, 1] = anchored[0], anchored[1], (anchored[3], anchored[2], 1)
    ends = [(-a, -n, p, t) for (t, p, f), (a, n, _) in best.items() if f and a >= least]
    if not ends:
        return []
    _, _, p, t = min(ends)
    out, key = [], (t, p, 1)
    while key:
        out.append(key[:2])
        key = best[key][2]
    return out[::-1]


def slow_runs(chain, flat_items):
    runs = [[chain[0]]]
    for x in chain[1:]:
        leap = x[1] - runs[-1][-1][1]
        if flat_items[x[1]] == flat_items[runs[-1][-1][1]] and leap <= 25 and (leap <= 6 or len(runs[-1]) >= 20):
            runs[-1].append(x)
        else:
            runs.append([x])
    return [r for r in runs if len(r) >= 4 and round(min(1, len(r) / (r[-1][1] - r[0][1] + 1)), 6) >= 0.55]


def slow_collected(doc, canon, first=40):
    flat = [w for _, text in canon for w in text.split()]
    items = [(k, pos) for k, text in canon for pos, _ in enumerate(text.split())]
    heard, out = list(enumerate(doc.split())), []
    for level in range(11):
        points = slow_points(heard, flat, first, 100, 25)
        place = {t: at for t, at, _, _ in points}
        chain = slow_chain(points)
        taken = set()
        for run in slow_runs(chain, [k for k, _ in items]) if chain else []:
            words = [place[t] for t, _ in run]
            spots = [items[p] for _, p in run]
            out.append((spots[0][0], level, min(words), max(words) + 1, spots[0][1], spots[-1][1] + 1, len(run)))
            taken |= set(words)
        if not taken:
            break
        heard = [x for x in heard if x[0] not in taken and x[1] in set(flat)]
    return out


def garbled(rng, canon):
    words = []
    for _ in range(rng.randrange(1, 5)):
        text = rng.choice(canon)[1].split()
        a = rng.randrange(len(text))
        for w in text[a : a + rng.randrange(3, 40)]:
            roll = rng.random()
            words += [] if roll < 0.08 else [w, "um"] if roll < 0.14 else [f"c{rng.randrange(5)}"] if roll < 0.2 else [w]
    return " ".join(words)


def test_collected_equals_a_quadratic_search(spark):
    rng = random.Random(0)
    canon = [(k, " ".join(rng.choice([f"c{rng.randrange(5)}", f"r{rng.randrange(60)}", f"u{k}x{j}"]) for j in range(rng.randrange(20, 70)))) for k in range(4)]
    docs = [(k, garbled(rng, canon)) for k in range(12)] + [(90, None), (91, ""), (92, "c1")]
    got = chains.collected(spark.createDataFrame(docs, DOC), spark.createDataFrame(canon, CANON)).collect()
    want = [(k, *r) for k, text in docs for r in slow_collected(text or "", canon)]
    assert sorted((r.doc_id, r.item_id, r.level, r.doc_from, r.doc_to, r.canon_from, r.canon_to, r.matched) for r in got) == sorted(want)
    assert len(want) > 12 and max(r[2] for r in want) > 0


def best(spark, doc, canon, **how):
    index = chains.flat_canon(spark.createDataFrame(canon, CANON), "item_id")
    heard = chains.heard_words(spark.createDataFrame([(1, doc)], DOC), "doc_id", index)
    rows = chains.best_chains(chains.near_seeds(heard, index, "doc_id", **how), "doc_id").collect()
    return sorted((r.t, r.p) for r in rows)


def test_common_words_extend_a_chain_but_start_none(spark):
    canon = [(k, "of the of the " + numbers(0, 4, f"v{k}_")) for k in range(9)]
    doc = "of the of the v3_0 v3_1"
    assert best(spark, doc, canon, common=5) == [(k, 24 + k) for k in range(6)]
    assert best(spark, "of the of the", canon, common=5) == []


def test_most_adjacent_places_win_before_length(spark):
    # five words in a row against seven with gaps
    canon = [(1, numbers(0, 5)), (2, " ".join(f"v{k} x" for k in range(8)))]
    doc = numbers(0, 8, "v") + " " + numbers(0, 5)
    assert best(spark, doc, canon) == [(k + 8, k) for k in range(5)]


def test_anchors_are_among_the_first_words(spark):
    canon = [(1, numbers(0, 10)), (2, "z")]
    doc = "z " * 40 + numbers(0, 10)
    assert best(spark, doc, canon) == []
    assert len(best(spark, doc, canon, first=None)) == 10


def test_other_spelling_and_vocative(spark):
    canon = [(1, "a b يَـٰٓأَيُّهَا ٱلصَّلَوٰةَ c d"), (2, "q")]
    assert best(spark, "a b يا ايها الصلاة c d", canon) == [(0, 0), (1, 1), (2, 2), (3, 2), (4, 3), (5, 4), (6, 5)]


def test_left_out_chapters_have_no_places(spark):
    from pyspark.sql import functions as F

    canon = spark.createDataFrame([(1, numbers(0, 9)), (2, numbers(5, 14))], CANON)
    docs = spark.createDataFrame([(1, numbers(0, 9))], DOC)
    (run,) = chains.collected(docs, canon, left_out=F.col("item_id") == 1).collect()
    assert run.way == "chain" and (run.item_id, run.doc_from, run.doc_to, run.canon_from, run.canon_to) == (2, 5, 9, 0, 4)
    assert chains.collected(docs.limit(0), canon).count() == 0 == chains.collected(docs, canon.limit(0)).count()


def slow_candidates(words, canon, top):
    flat = [w for _, text in canon for w in text.split()]
    score = {k: sum(1_000_000 // (1 + flat.count(w)) for w in words[:60] for x in text.split() if x == w) for k, text in canon}
    return [k for k in sorted(score, key=lambda k: (-score[k], k)) if score[k]][:top]


def slow_lanes(doc, canon, long, rest):
    """The rule round by round, for transcripts that stay long enough for lanes."""
    from spanwright.operators.search import align_pair

    flat, base, items = [], {}, []
    for k, text in canon:
        base[k] = len(flat)
        flat += text.split()
        items += [k] * len(text.split())
    heard, out = [(at, w) for at, w in enumerate(doc.split()) if w in flat], []
    for level in range(11):
        if len(heard) < long:
            return out, len(heard)
        taken = set()
        for k in slow_candidates([w for _, w in heard], canon, 4):
            text = dict(canon)[k].split()
            found = align_pair([w for _, w in heard], text, {w: 1 / (1 + flat.count(w)) for w in text})
            if len(found) < 10:
                continue
            for run in slow_runs([(i, base[k] + j) for i, j in found], items):
                words = [heard[i][0] for i, _ in run]
                out.append((k, level, min(words), max(words) + 1, run[0][1] - base[k], run[-1][1] - base[k] + 1, len(run)))
                taken |= set(words)
        heard = [x for x in heard if x[0] not in taken]
        if not taken or not heard or len(heard) < rest and set(slow_candidates([w for _, w in heard], canon, 2)) & {r[0] for r in out}:
            return out, 0
    return out, 0


def test_lanes_equal_the_rule_round_by_round(spark):
    rng = random.Random(5)
    canon = [(k, " ".join(rng.choice([f"c{rng.randrange(6)}", f"u{k}x{j}", f"u{k}x{j}"]) for j in range(80))) for k in range(6)]
    docs = []
    for d in range(8):
        parts = []
        for _ in range(rng.randrange(2, 6)):
            text = canon[rng.randrange(6)][1].split()
            parts += [w for w in text if rng.random() > 0.1] if rng.random() > 0.3 else [f"c{rng.randrange(6)}" for _ in range(30)]
        docs.append((d, " ".join(parts)))
    got = chains.collected(spark.createDataFrame(docs, DOC), spark.createDataFrame(canon, CANON), long=20, rest=60).filter("way = 'lane'").collect()
    want = [(d, *r) for d, text in docs for r in slow_lanes(text, canon, 20, 60)[0]]
    assert sorted((r.doc_id, r.item_id, r.level, r.doc_from, r.doc_to, r.canon_from, r.canon_to, r.matched) for r in got) == sorted(want)
    assert max(r[2] for r in want) >= 1 and len(want) > 12


def test_a_long_transcript_changes_to_chains(spark):
    """Lanes take the long chapter, what is left is short and of a new chapter, so a chain takes that one."""
    canon = [(1, numbers(0, 60)), (2, numbers(0, 20, "v"))]
    docs = spark.createDataFrame([(1, numbers(0, 60) + " " + numbers(4, 12, "v"))], DOC)
    runs = chains.collected(docs, spark.createDataFrame(canon, CANON), long=30, rest=40).collect()
    assert sorted((r.item_id, r.way, r.level, r.doc_from, r.doc_to) for r in runs) == [(1, "lane", 0, 0, 60), (2, "chain", 1, 60, 68)]


def test_occurrences_weigh_candidates(spark):
    """A word counts for each time that a row has it, and less the more often the canon has it."""
    from spanwright.operators import search

    canon = spark.createDataFrame([(1, "a a a b"), (2, "a b b"), (3, "c")], CANON)
    docs = spark.createDataFrame([(1, "a"), (2, "a b b"), (3, "d"), (4, None)], DOC)
    got = sorted((r.doc_id, r.item_id, r.score, r.place) for r in search.idf_candidates(docs, canon).collect())
    a, b = 1_000_000 // 5, 1_000_000 // 4
    assert got == [(1, 1, 3 * a, 1), (1, 2, a, 2), (2, 1, 3 * a + 2 * b, 2), (2, 2, a + 4 * b, 1)]


def test_a_word_of_all_rows_is_not_dropped(spark):
    from spanwright.operators import search

    canon = spark.createDataFrame([(k, "the " * (k % 3 + 1)) for k in range(150)], CANON)
    docs = spark.createDataFrame([(1, "the")], DOC)
    got = sorted((r.place, r.item_id) for r in search.idf_candidates(docs, canon).collect())
    assert got == [(1, 2), (2, 5), (3, 8)]
