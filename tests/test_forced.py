"""Forced alignment against a literal table of all states and frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.operators import forced
from spanwright.plans import aligned

SYMBOLS = ["-", "|", *"abcd"]


def slow(frames, letters, block, margin):
    """The path's states, by whole tables of scores and moves."""
    n, scores, tables, anchor = len(letters), {0: 0.0}, [], 0
    of = lambda s: 0 if s % 2 == 0 else letters[s // 2]
    for f0 in range(0, len(frames), block):
        own = frames[f0 : f0 + block]
        low = max(0, anchor - margin)
        high = max(min(n, anchor + max(1, round(len(own) / len(frames) * n)) + margin), min(n, low + 1))
        stretch = range(2 * low, 2 * high + 1)
        for p in own:
            new, moved = {}, {}
            for s in stretch:
                stay = scores.get(s, -1e30) + p[of(s)]
                move = scores.get(s - 1, -1e30) + p[of(s)] if s > 2 * low else -1e30
                moved[s] = move > stay
                new[s] = max(stay, move)
            scores |= new
            tables.append(moved)
        best = max(stretch, key=lambda s: (scores.get(s, -1e30), -s))
        anchor = best // 2
    if scores.get(best, -1e30) <= -1e20:
        return None
    path, s = [], best
    for moved in reversed(tables):
        path.append(s)
        s -= moved.get(s, False)
    return path[::-1]


def case(rng, words, slow_down):
    text = "|".join(words)
    frames = []
    for c in text:
        for _ in range(rng.randrange(1, slow_down)):
            p = [float(-rng.randrange(3, 9)) for _ in SYMBOLS]
            p[SYMBOLS.index(c) if rng.random() < 0.8 else 0] = float(-rng.randrange(4))
            frames.append(p)
    return frames


@pytest.mark.parametrize(("block", "margin"), [(3000, 80), (40, 6)])
def test_words_of_frames(spark, block, margin):
    rng = random.Random(block)
    texts = {k: ["".join(rng.choices("abcd", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 25))] for k in range(24)}
    frames = {k: case(rng, w, 5) for k, w in texts.items()}
    for k in range(0, 24, 5):  # cut clips
        frames[k] = frames[k][: max(1, len(frames[k]) // 2)]
    texts |= {100: [], 101: ["abz"], 102: ["ab", "", "c"], 103: ["ab"], 104: None}
    frames |= {100: [[0.0] * 6] * 3, 101: [[0.0] * 6] * 3, 102: case(rng, ["ab", "", "c"], 4), 105: [[0.0] * 6]}
    got = {}
    rows = spark.createDataFrame([(k, f, p) for k, own in frames.items() for f, p in enumerate(own)], "clip long, frame long, p array<double>").repartition(5)
    known = spark.createDataFrame([*texts.items(), (None, ["ab"])], "clip long, canon array<string>")
    for r in forced.aligned_words(rows, known, "clip", SYMBOLS, block, margin).collect():
        got[r.clip, r.idx] = (r.word, r.start_ms, r.end_ms)
    want = {}
    for k, own in texts.items():
        text = "|".join(own or [])
        if not text or k not in frames or set(text) - set(SYMBOLS):
            continue
        path = slow(frames[k], [SYMBOLS.index(c) for c in text], block, margin)
        word_of = {}
        for i, c in enumerate(text):
            if c != "|":
                word_of[i] = text[:i].count("|")
        spans = {}
        for f, s in enumerate(path or []):
            if s % 2 and s // 2 in word_of:
                spans.setdefault(word_of[s // 2], []).append(f)
        if sorted(spans) == list(range(len(spans))):
            want |= {(k, w): (own[w], 20 * min(f), 20 * max(f) + 20) for w, f in spans.items()}
    assert got == want and {k for k, _ in want} >= {0, 1, 2}
    assert (102, 2) not in got


def test_frames_of_other_clips_and_no_broadcast_of_frames(spark):
    """Frames without a text are left out, and frames are never sent around as a table that looks small."""
    frames = spark.range(300).selectExpr("id div 100 as clip", "id % 100 as frame", "array(0D, -1D, 0D, -1D, -1D, -1D) as p")
    texts = spark.createDataFrame([(1, ["aa"])], "clip long, canon array<string>")
    own = texts.select("clip", forced.letters_of(texts.canon, SYMBOLS).alias("letters"))
    spans = forced.letter_frames(frames, own, "clip")
    assert {r.clip for r in spans.collect()} <= {1}
    plan = spans._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any("BroadcastExchange" in x and "frame" in x for x in plan.splitlines())


@pytest.mark.parametrize(("block", "margin"), [(3000, 80), (40, 6), (7, 1)])
def test_clips_in_step_equal_clips_one_by_one(monkeypatch, block, margin):
    """Clips of any lengths, cut ones and texts longer than their frames among them, whose scores come in pieces."""
    rng = np.random.default_rng(block)

    def pieces():
        own = np.random.default_rng(1)
        for k in range(60):
            n, frames = int(own.integers(1, 60)), int(own.integers(1, 250))
            clip = forced._Clip(k, own.integers(1, 6, n), None, frames)
            scores = -own.integers(0, 9, (frames, 6)).astype(float)
            yield from ((clip, p) for p in np.array_split(scores, int(own.integers(1, min(4, frames + 1)))))

    def found(held, states):
        monkeypatch.setattr(forced, "HELD", held)
        monkeypatch.setattr(forced, "STATES", states)
        return {c.key: (letter, list(first), list(last)) for c, letter, first, last in forced._streamed(pieces(), block, margin)}

    want = found(0, 1)
    assert len(want) > 50 and found(1000, 1) == want
    assert found(1000, 100_000) == want and found(100, int(rng.integers(200, 2000))) == want


def test_frames_scored_in_the_task_equal_frames_of_a_table(spark, tmp_path):
    """The query's frames as a table, a row a frame, give the same words; scored in the task, they are not dealt."""
    said = ["and so it goes on for a while, twice", "", None, "Überall  bell bell", "a", " ".join(f"w{k}" for k in range(700))]
    spark.createDataFrame([(k // 2, k % 2, "user", t) for k, t in enumerate(said)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = aligned.forced_words(spark, str(tmp_path))
    spelled = lambda w: "".join(aligned.ALPHABET[ord(c) % 26] for c in w)
    texts = spark.createDataFrame([(k // 2 * 1000 + k % 2, [spelled(w) for w in t.split()]) for k, t in enumerate(said) if t], "clip_id long, canon array<string>")
    letters = texts.select("clip_id", forced.letters_of(F.col("canon"), aligned.SYMBOLS).alias("letters")).collect()
    rows = [(clip, f, p) for clip, own in letters for f, p in enumerate(np.concatenate(list(aligned._scores(clip, np.array(own))[1])).tolist())]
    frames = spark.createDataFrame(rows, "clip_id long, frame long, p array<double>")
    want = forced.aligned_words(frames, texts, "clip_id", aligned.SYMBOLS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 400
    lasting = F.flatten(F.transform("letters", lambda c, k: F.array_repeat(c, ((k * 7 + F.col("clip_id")) % 3 + 1).cast("int"))))
    own = spark.createDataFrame(letters, "clip_id long, letters array<int>").select("clip_id", F.posexplode(lasting).alias("frame", "symbol"))
    noise = lambda s: -(F.pmod(F.col("frame") * 31 + s * 17 + F.col("clip_id") * 7, F.lit(50)) + 1)
    p = F.array(*(F.when((F.col("symbol") == s) & (F.col("frame") % 9 != 8), 0).otherwise(noise(s)).cast("double") for s in range(len(aligned.SYMBOLS))))
    assert sorted(map(tuple, own.select("clip_id", "frame", p).collect())) == sorted(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.count("MapInArrow") == 1 and "Join" not in plan and "Aggregate" not in plan
