"""Cues from timed words against a literal loop, and the order of the steps."""

import random

import pytest

from spanwright.operators import answers, composed, cues

WORD = "clip_id long, group long, idx long, start_ms long, end_ms long, place int"
GROUP = "clip_id long, group long, canon array<string>, translation array<string>"
SPAN = "clip_id long, start_ms long, end_ms long"


def slow_phrases(words, canon, silence):
    """[(first, last, start, end)] of one group: words (start, end, place) in order of time."""
    cuts = []
    for i, (x, y) in enumerate(zip(words, words[1:], strict=False)):
        a, b = x[1] - 120, y[0] + 120
        if sum(max(0, min(b, t) - max(a, s)) for s, t in silence) >= 400:
            cuts.append(i + 1)
    parts = [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)], strict=True)]
    n = len(canon)
    if len(parts) == 1:
        return [(0, n, words[0][0], words[-1][1])]
    out, before, done = [], 0, 0
    by_place = n > 0 and all(any(w[2] is not None for w in p) for p in parts)
    for k, p in enumerate(parts):
        last = k == len(parts) - 1
        done += len(p)
        if by_place:
            own = [w[2] for w in p if w[2] is not None]
            a, b = min(own), max(own)
            if k == 0 and a <= 2:
                a = 0
            if last and n - 1 - b <= 2:
                b = n - 1
            a, b = min(a, before), b + 1
        else:
            a = before
            b = n if last else min(n * done // len(words), n - (len(parts) - k - 1))
            if n and b <= a:
                b = min(a + 1, n)
        out.append((a, b, p[0][0], p[-1][1]))
        before = b
    return out


@pytest.mark.parametrize("places", [True, False])
def test_phrases_of_groups(spark, places):
    rng = random.Random(places)
    words, groups, silence, want = [], [], [], {}
    for clip in range(8):
        t = 0
        for g in range(4):
            own = []
            for k in range(rng.randrange(1, 14)):
                t += rng.choice([20, 60, 700])
                own.append((t, t + 200, rng.choice([k, k, max(0, k - 3), None]) if places else None))
                t += 200
            n = max([w[2] for w in own if w[2] is not None], default=-1) + 1 + rng.randrange(5) if places else rng.randrange(0, 9)
            groups.append((clip, g, [f"w{k}" for k in range(n)], []))
            words.append((clip, g, own))
        flat = [w for c, _, o in words if c == clip for w in o]
        free = [(a[1], b[0]) for a, b in zip(flat, flat[1:], strict=False) if b[0] - a[1] >= 60]
        silence += [(clip, a + 5, b - 5) for a, b in free if rng.random() < 0.8]
    rows = []
    for clip, g, own in words:
        canon = next(x[2] for x in groups if x[:2] == (clip, g))
        for k, x in enumerate(slow_phrases(own, canon, [s[1:] for s in silence if s[0] == clip])):
            want[clip, g, k] = (*x[2:], " ".join(canon[x[0] : x[1]]) if x[1] > x[0] else "")
        rows += [(clip, g, g * 100 + k, *w) for k, w in enumerate(own)]
    got = composed.phrase_texts(spark.createDataFrame(rows, WORD), spark.createDataFrame(groups, GROUP), spark.createDataFrame(silence, SPAN))
    assert {(r.clip_id, r.group, r.phrase): (r.start_ms, r.end_ms, r.text) for r in got.collect()} == want
    assert len(want) > 40


def test_translations_are_whole(spark):
    rows = [(1, 1, k, 1000 * k, 1000 * k + 300, k) for k in range(6)] + [(1, 2, 10, 9000, 9100, None), (2, 1, 0, 0, 100, 0)]
    groups = [(1, 1, list("abcdef"), "one two, three four five six seven eight".split()), (1, 2, None, None)]
    silence = [(1, 1000 * k + 310, 1000 * k + 990) for k in (1, 3)]
    got = composed.phrase_texts(spark.createDataFrame(rows, WORD), spark.createDataFrame(groups, GROUP), spark.createDataFrame(silence, SPAN))
    found = {(r.clip_id, r.group, r.phrase): (r.text, r.translation) for r in got.collect()}
    assert [found[1, 1, k][0] for k in range(3)] == ["a b", "c d", "e f"] and " ".join(found[1, 1, k][1] for k in range(3)) == " ".join(groups[0][3])
    assert found[1, 1, 0][1] == "one two," and found[1, 2, 0] == ("", "") and found[2, 1, 0] == ("", "")


def test_cues_of_word_times(spark):
    words = [(1, 0, -2, 0, 400), (1, 1, 0, 500, 900), (1, 2, 5, 1000, 1300), (1, 3, 5, 2300, 2700), (1, 4, 6, 3000, 3900), (1, 5, None, 4000, 4100)]
    verses = [(5, "a b c d".split(), "one two three four".split()), (6, "e f g".split(), "x y z".split())]
    openings = {-2: (0, "I seek", "seeking"), 0: (1, "in name", "naming")}
    run = lambda offsets, silence: [tuple(r) for r in composed.word_time_cues(spark.createDataFrame(words, "clip_id long, idx long, verse int, start_ms long, end_ms long"), spark.createDataFrame(verses, "verse int, canon array<string>, translation array<string>"), spark.createDataFrame(offsets, "clip_id long, verse int, first int, last int"), openings, silence).orderBy("start_ms").collect()]
    got = run([(1, 5, 1, 4), (1, 6, 0, 3)], spark.createDataFrame([(1, 1350, 2250)], SPAN))
    # verse 5 shows as many words as were heard, from the second one on; its two phrases have a breath between them
    assert [(c[3], c[4]) for c in got] == [("I seek", "seeking"), ("in name", "naming"), ("b", got[2][4]), ("c", got[3][4]), ("e", "x y z")]
    assert got[2][2] <= 1350 and got[3][1] >= 2250
    whole = run([], None)
    assert [c[3] for c in whole] == ["I seek", "in name", "a b c d", "e f g"]


def test_order_of_steps_matters(spark):
    """A breath that begins in a cue's lead-in is none inside the cue; trimmed after it is led in, the cue would end there."""
    found = spark.createDataFrame([(1, 1000, 2000, "a", "x")], f"{SPAN}, text string, translation string")
    breaths = spark.createDataFrame([(1, 985, 1385)], SPAN)
    assert [r.end_ms for r in cues.show(cues.trim_overhang(found, breaths), breaths, composed.TEXTS).collect()] == [2060]
    assert [r.end_ms for r in cues.trim_overhang(cues.show(found, breaths, composed.TEXTS), breaths).collect()] == [985]


def test_cues_of_an_answer(spark):
    opening = [answers.Opening("seek", 1, 0, "I seek", "seeking", "isti", ("0:1",)), answers.Opening("name", 1, 1, "in name", "naming", "basmala", ("0:0",))]
    segments = spark.createDataFrame([(1, 0, "special", "isti", 0), (1, 1, None, None, 2000)], "clip_id long, seg long, kind string, special string, from_ms long")
    words = [(1, 0, 0, "0:1:1", 0, 400), (1, 0, 1, "0:1:2", 500, 900), *((1, 1, k, f"2:1:{p}", s, s + 300) for k, (p, s) in enumerate([(2, 0), (3, 400), (2, 1700), (3, 2100), (4, 2500)]))]
    verses = spark.createDataFrame([(2, 1, "a b c d e".split(), "one two three four five".split())], "chapter int, verse int, canon array<string>, translation array<string>")
    answer = answers.read_answer(segments, spark.createDataFrame(words, "clip_id long, seg long, w long, location string, start_ms long, end_ms long"), verses, opening)
    got = [tuple(r) for r in composed.answer_cues(answer, spark.createDataFrame([(1, 2720, 3680)], SPAN)).orderBy("start_ms").collect()]
    assert [c[3] for c in got] == ["I seek", "b c", "b c d"]
    assert got[1][2] <= 2720 and got[2][1] >= 3680
