"""Intervals, cues and signals: known cases, and literal loops on random data. Times in milliseconds."""

import random

import pytest
from pyspark.sql import functions as F

from spanwright.operators import cues, intervals, runs, signal
from spanwright.sources import subtitles

SPAN = "clip_id long, start_ms long, end_ms long"
CUE = SPAN + ", text string"


def spans(spark, *pairs, clip=1):
    return spark.createDataFrame([(clip, *p) for p in pairs], SPAN)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or ("start_ms", "end_ms"))).collect())


def test_known_intervals(spark):
    key = ["clip_id"]
    assert got(intervals.merge(spans(spark, (0, 1000), (2500, 3500)), key, 2000)) == [(0, 3500)]
    assert got(intervals.merge(spans(spark, (0, 1000), (5000, 6000)), key, 2000)) == [(0, 1000), (5000, 6000)]
    assert got(intervals.pack_chunks(spans(spark, (0, 75_000)), key)) == [(0, 30_000), (30_000, 60_000), (60_000, 75_000)]
    assert got(intervals.pack_chunks(spans(spark, (0, 10_000), (12_000, 20_000), (22_000, 29_000)), key)) == [(0, 29_000)]
    assert got(intervals.padded_hull(spans(spark, (10_000, 20_000)), key)) == [(8500, 21_500)]
    windows = got(intervals.overlapped_windows(spark.createDataFrame([(1, 7_575_000)], "clip_id long, duration_ms long"), key))
    assert len(windows) == 64 and windows[0][0] == 0 and windows[-1][1] == 7_575_000 and all(b - a <= 136_000 for a, b in windows)
    assert got(intervals.coverage(spans(spark, (10_000, 12_000)), spans(spark, (10_000, 12_000)), key), "ratio") == [(1.0,)]
    assert got(intervals.coverage(spans(spark, (10_000, 12_000)), spans(spark, (10_000, 10_000)), key), "ratio") == [(0.0,)]


def test_random_intervals(spark):
    rng = random.Random(1)
    rows = [(c, s, s + rng.randrange(-1, 30)) for c in range(4) for s in (rng.randrange(400) for _ in range(40))]
    more = [(c, s, s + rng.randrange(0, 30)) for c in range(5) for s in (rng.randrange(400) for _ in range(15))]
    a = spark.createDataFrame([*rows, rows[0], (None, 1, 2), (1, None, 2)], SPAN)
    b = spark.createDataFrame(more, SPAN)
    inside = lambda given: {(c, t) for c, s, e in given for t in range(s, e)}
    held = lambda df: {(r.clip_id, t) for r in df.collect() for t in range(r.start_ms, r.end_ms)}
    assert held(intervals.merge(a, ["clip_id"], bucket_ms=50)) == inside(rows)
    assert held(intervals.subtract(a, b, ["clip_id"])) == inside(rows) - inside(more)
    want = sorted((x, y) for x in rows for y in more if x[0] == y[0] and min(x[2], y[2]) - max(x[1], y[1]) > 2)
    pairs = intervals.overlaps(a.dropDuplicates(), b, ["clip_id"], 2, bucket_ms=20)
    assert sorted(((r.clip_id, r.start_ms, r.end_ms), (r.clip_id, r.other_start_ms, r.other_end_ms)) for r in pairs.collect()) == sorted((x, y) for x, y in want if x in set(rows)) or len(set(rows)) < len(rows)
    points = [(c, rng.randrange(450)) for c in range(6) for _ in range(20)]
    found = intervals.nearest(spark.createDataFrame(points, "clip_id long, t_ms long"), a.select("clip_id", F.col("start_ms").alias("t_ms")), ["clip_id"], 9, bucket_ms=30)
    near = []
    for c, t in points:
        best = min(((abs(t - s), s) for k, s, _ in rows if k == c), default=(10, 0))
        near += [(c, t, best[1])] if best[0] <= 9 else []
    assert got(found, "clip_id", "t_ms", "nearest_ms") == sorted(near)
    assert intervals.gaps(a.limit(0), ["clip_id"], 1).count() == 0


def slow_hysteresis(frames, high, low, silence, longer):
    on = off = None
    out = []
    for t, p in frames:
        if p >= high:
            off = None
            on = t if on is None else on
        elif p < low and on is not None:
            off = t if off is None else off
            if t - off >= silence:
                out.append((on, off))
                on = off = None
    if on is not None:
        out.append((on, frames[-1][0]))
    return sorted(x for x in out if x[1] - x[0] > longer)


def test_hysteresis_equals_a_loop(spark):
    rng = random.Random(2)
    for _ in range(3):
        frames = [(32 * k, rng.choice([0.1, 0.4, 0.6, 0.1, 0.1])) for k in range(300)]
        df = spark.createDataFrame([(1, *f) for f in frames], "clip_id long, t_ms long, p double")
        segments = runs.hysteresis(df, ["clip_id"], 0.5, 0.35, 100, 250, F.floor(F.col("t_ms") / 1000))
        assert got(segments) == slow_hysteresis(frames, 0.5, 0.35, 100, 250)


def shown(spark, given, silent=()):
    df = cues.show(spark.createDataFrame([(1, *c) for c in given], CUE), spans(spark, *silent) if silent else spans(spark, (0, 1)).limit(0))
    return got(df, "start_ms", "end_ms", "text")


def test_padding_cases(spark):
    one = shown(spark, [(51_108, 51_130, "a"), (51_158, 52_200, "a")])
    assert len(one) == 1 and one[0][0] == 51_138 and one[0][2] == "a"
    two = shown(spark, [(10_000, 10_400, "a"), (10_450, 10_500, "b")], [(10_560, 11_500)])
    assert two[1][0] == 10_430 and all(s < e <= 10_560 for s, e, _ in two)
    assert [c[:2] for c in shown(spark, [(10_000, 10_400, "a"), (12_000, 12_500, "b")])] == [(9980, 10_480), (11_980, 12_560)]
    assert shown(spark, [(0, 5, "x")])[0][0] == 50
    # no room: the text goes on to the next, and is not said twice; the last one is always shown
    assert [c[2] for c in shown(spark, [(1000, 1100, "a"), (1010, 1100, "a"), (1020, 3000, "a c")])] == ["a c"]
    assert shown(spark, [(1000, 1001, "a"), (1001, 1002, "b")], [(900, 5000)])[0] == (5000, 5500, "a b")
    # moved behind the silence that it begins in, and cut off where the next begins
    assert [c[0] for c in shown(spark, [(1000, 3000, "a"), (4000, 5000, "b")], [(900, 1500)])] == [1500, 3980]
    assert cues.show(spark.createDataFrame([], CUE), spans(spark, (0, 1))).count() == 0


def test_shown_cues_keep_their_distance(spark):
    rng = random.Random(4)
    given = sorted((t, t + rng.randrange(1, 1500), f"t{k}") for k, t in enumerate(rng.sample(range(60_000), 60)))
    silent = [(t, t + rng.randrange(250, 700)) for t in range(500, 60_000, 1500)]
    rows = shown(spark, given, silent)
    assert all(x[0] < x[1] for x in rows) and all(y[0] - x[1] >= 50 for x, y in zip(rows, rows[1:], strict=False))
    # every text is shown, alone or with those that it made no room for
    assert all(sum(t in x.split() or any(t in w for w in x.split()) for *_, x in rows) >= 1 for *_, t in given)
    assert len(rows) < len(given)


def word_rows(*pairs):
    out, t = [], 0
    for length, gap in pairs:
        out.append((t, t + length))
        t += length + gap
    return out


WORD = "clip_id long, idx long, start_ms long, end_ms long"


def phrase_count(spark, rows, silent):
    df = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], WORD)
    runs_ = None if silent is None else spans(spark, *silent) if silent else spans(spark, (0, 1)).limit(0)
    found = [r.phrase for r in cues.phrases(df, runs_).orderBy("idx").collect()]
    assert found == sorted(found) and len(found) == len(rows)
    return len(set(found))


def test_phrase_cases(spark):
    assert phrase_count(spark, word_rows(*[(400, 100)] * 4), None) == 1
    assert phrase_count(spark, word_rows((400, 100), (400, 700), (400, 100), (400, 100)), None) == 1
    six = [(400, 100), (400, 100), (400, 1200), (400, 100), (400, 100), (400, 100)]
    assert phrase_count(spark, word_rows(*six), None) == 2
    assert phrase_count(spark, word_rows((200, 1200), *[(400, 100)] * 2, (400, 1200), *[(400, 100)] * 3), None) == 2
    own = word_rows(*six)
    assert phrase_count(spark, own, []) == 1 and phrase_count(spark, own, [(own[2][1], own[3][0])]) == 2
    assert cues.phrases(spark.createDataFrame([], WORD), None).count() == 0


def snapped(spark, start, end, *silent):
    df = cues.snap_words(spark.createDataFrame([(1, 0, start, end)], WORD), spans(spark, *silent))
    return got(df)[0]


def test_snapping_and_grouping(spark):
    assert snapped(spark, 1000, 2600, (1200, 2200)) == (1000, 1200)
    assert snapped(spark, 500, 1240, (1200, 2800)) == (500, 1200) and snapped(spark, 2760, 3000, (1200, 2800)) == (2800, 3000)
    assert snapped(spark, 5000, 5200, (1200, 2800)) == (5000, 5200)
    # a long run that the word begins just before: the longer side stays
    assert snapped(spark, 900, 3000, (1000, 1450)) == (1450, 3000)
    rows = [(0, 100, 0), (150, 250, 1), (600, 700, 2), (750, 800, 1), (820, 900, 2), (910, 950, 4), (951, 960, None), (1300, 1310, 9), (1311, 1320, 11), (1321, 1330, 12)]
    df = spark.createDataFrame([(1, 0, k, *r) for k, r in enumerate(rows)], "clip_id long, phrase long, idx long, start_ms long, end_ms long, place long")
    assert [r.cue for r in cues.grouped(df).orderBy("idx").collect()] == [0, 0, 1, 2, 2, 3, 3, 4, 4, 5]


def slow_requests(slices, ends, longest, late=0.6):
    plan = []
    for s, e in sorted(slices):
        if plan and e - plan[-1][0] <= longest:
            plan[-1] = (plan[-1][0], e)
        else:
            plan.append((s, e))
        while plan[-1][1] - plan[-1][0] > longest:
            a, b = plan.pop()
            at = max([t for t in ends if a + late * longest <= t <= a + longest], default=a + longest)
            plan += [(a, at), (at, b)]
    return plan


def test_requests_equal_a_loop(spark):
    rng = random.Random(6)
    for _ in range(3):
        t, slices = 0, []
        for _ in range(15):
            t += rng.randrange(10, 60)
            slices.append((t, t + rng.choice([20, 50, 90, 400])))
            t = slices[-1][1]
        ends = sorted({rng.randrange(t) for _ in range(30)})
        found = intervals.request_plan(spans(spark, *slices), spans(spark, *((x - 1, x) for x in ends)), ["clip_id"], 100)
        assert got(found) == slow_requests(slices, ends, 100)


def test_wordless_gaps(spark):
    cue = lambda *rows: spark.createDataFrame([(1, s, e, t) for s, e, t in rows], CUE)
    two = cue((0, 2000, "a"), (5000, 7000, "b"))
    none = spans(spark, (0, 1)).limit(0)
    assert got(cues.close_gaps(two, none)) == [(0, 4999), (5000, 7000)]
    assert got(cues.close_gaps(two, spans(spark, (2000, 5000)))) == [(0, 2000), (5000, 7000)]
    three = cues.close_gaps(cue((136_770, 145_470, "a"), (149_264, 173_734, "b")), spans(spark, (145_470, 146_018)))
    assert got(three, "start_ms", "end_ms", "text") == [(136_770, 145_470, "a"), (146_018, 149_263, "a"), (149_264, 173_734, "b")]
    four = cues.close_gaps(cue((0, 1500, "a"), (8000, 9000, "b")), spans(spark, (1500, 2500), (4000, 5500)))
    assert got(four) == [(0, 1500), (2500, 3999), (5500, 7999), (8000, 9000)]
    assert got(cues.trim_overhang(cue((0, 2000, "a")), spans(spark, (1500, 1700), (0, 5)))) == [(0, 1500)]


def test_audit_cases(spark):
    def kinds(speech, *shown):
        df = cues.audit(spark.createDataFrame([(1, s, e, "x") for s, e in shown], CUE), spans(spark, *speech))
        return sorted((r.kind, r.t0_ms, r.t1_ms) for r in df.collect())

    assert kinds([(1000, 5000), (6000, 10_000)], (1000, 5000), (6000, 10_000)) == []
    assert kinds([(1000, 3000), (5000, 7000)], (1000, 5500))[-1] == ("over_silence", 3000, 5000)
    assert kinds([(1000, 3000), (3300, 5000)], (1000, 5000)) == []
    assert [k for k, _, _ in kinds([(1000, 3000), (5000, 8000)], (1000, 3000))] == ["empty_speech"]
    assert {"zero_duration", "flash_cue", "overlap"} <= {k for k, _, _ in kinds([(0, 10_000)], (1000, 1000), (2000, 2100), (4000, 8000), (7500, 10_000))}


def test_drift_is_taken_out(spark):
    ws = spark.createDataFrame([(1, 0, 1200, 1400), (1, 1, 2000, 2200), (1, 2, 2900, 3100), (1, 3, 9000, 9100)], "clip_id long, idx long, start_ms long, end_ms long")
    moved = {r.idx: (r.start_ms, r.end_ms) for r in cues.corrected_words(ws, spans(spark, (1000, 3300))).collect()}
    # shifts of -200 at the slice's start and 200 at its end, by the place of each word's start between
    assert moved == {0: (1035, 1235), 1: (1974, 2174), 2: (3030, 3230), 3: (9000, 9100)}


def test_signals(spark):
    rows = [(1, i, float(i == 500)) for i in range(1000)]
    df = spark.createDataFrame(rows, "clip_id long, i long, x double")
    pooled = {r.b: r.x for r in signal.max_pool(df, ["clip_id"], 100).collect()}
    assert len(pooled) == 100 and pooled[50] == 1.0 and sum(pooled.values()) == 1.0
    assert signal.max_pool(df, ["clip_id"], 1200).count() == 1200
    carried = {r.b: r.x for r in signal.bucket_max_carried(df, ["clip_id"], 100).collect()}
    assert [carried[b] for b in range(10)] == [0.0] * 5 + [1.0] * 5


@pytest.mark.parametrize("sink", [subtitles.srt, subtitles.vtt])
def test_subtitles(spark, sink, tmp_path):
    df = spark.createDataFrame([(1, 3_723_004, 3_724_000, "b, c"), (1, 20, 1500, "a"), (1, 90, 95, None)], CUE)
    body = sink(df).first().body
    mark = "," if sink is subtitles.srt else "."
    assert f"01:02:03{mark}004 --> 01:02:04{mark}000\nb, c\n" in body and f"1\n00:00:00{mark}020" in body
    subtitles.write_subtitles(sink(df), str(tmp_path / "out"))
    assert [p.parent.name for p in tmp_path.glob("out/*/part*")] == ["clip_id=1"]


def test_requests_are_halved(spark):
    rows = [(1, 0, 100, "a"), (1, 200, 209, "b"), (2, 0, 1601, "c"), (3, 5, 6, None), (4, None, 9, "d")]
    df = spark.createDataFrame(rows, "clip_id long, start_ms long, end_ms long, name string")
    got = intervals.halved(df, ["clip_id"], F.when(F.col("name").isNotNull(), F.col("end_ms") - F.col("start_ms") > 30), 20, 2)
    assert sorted((r.clip_id, r.start_ms, r.end_ms, r.depth, r.failed) for r in got.collect()) == [
        *((1, k, k + 25, 2, False) for k in (0, 25, 50, 75)),
        (1, 200, 209, 0, False),
        *((2, a, b, 2, True) for a, b in ((0, 400), (400, 800), (800, 1200), (1200, 1601))),
        (3, 5, 6, 0, False),
    ]
    # too short to be halved, or no round left
    assert {(r.depth, r.failed) for r in intervals.halved(df, ["clip_id"], F.col("end_ms") > 30, 1000, 0).collect()} == {(0, True), (0, False)}
