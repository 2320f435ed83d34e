import pytest
from pyspark.sql import functions as F

from spanwright.operators import edges, runs

SPAN = "clip_id long, start_ms long, end_ms long"


def spans(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], SPAN)


@pytest.mark.parametrize(
    ("first", "last", "speech", "want"),
    [
        ((10_700, 11_000), (14_000, 14_500), [(10_000, 15_000)], (10_000, 15_000)),
        ((10_050, 10_500), (10_900, 11_300), [(10_000, 12_500)], (10_000, 12_500)),
        ((12_000, 12_500), (14_500, 15_000), [(0, 30_000)], (12_000, 15_000)),
        ((11_200, 11_500), (11_200, 11_500), [(10_000, 11_000), (12_000, 15_000)], (11_200, 11_500)),
        ((10_000, 10_900), (10_000, 10_900), [(10_600, 10_700)], (10_600, 10_700)),
        ((10_000, 10_900), (10_000, 10_900), [], (10_000, 10_900)),
    ],
)
def test_clamp(spark, first, last, speech, want):
    rows = spark.createDataFrame([(1, 7, first[0], last[1], *first, *last), (1, 8, None, None, None, None, None, None)], "clip_id long, phrase_id long, start_ms long, end_ms long, first_start_ms long, first_end_ms long, last_start_ms long, last_end_ms long")
    got = {r.phrase_id: (r.start_ms, r.end_ms) for r in edges.clamp(rows, spans(spark, *speech)).collect()}
    assert got == {7: want, 8: (None, None)}


@pytest.mark.parametrize(
    ("end", "held", "final", "cap", "speech", "silence", "want"),
    [
        (5000, True, True, None, [(0, 20_000)], [], 8500),
        (5000, True, True, None, [(0, 6000)], [], 6000),
        (5000, True, True, None, [(0, 20_000)], [(6000, 6500)], 6000),
        (3000, True, False, None, [(0, 20_000)], [], 4800),
        (3000, True, False, 4000, [(0, 20_000)], [], 4000),
        (5000, False, True, None, [(0, 20_000)], [], 5000),
        (5000, True, True, None, [], [], 5000),
        (5000, True, True, None, [(0, 20_000)], [(4980, 5500)], 5000),
    ],
)
def test_hold_tails(spark, end, held, final, cap, speech, silence, want):
    rows = spark.createDataFrame([(1, 7, 0, end, held, final, cap)], "clip_id long, phrase_id long, start_ms long, end_ms long, held boolean, final boolean, cap_ms long")
    assert [r.end_ms for r in edges.hold_tails(rows, spans(spark, *speech), spans(spark, *silence)).collect()] == [want]


def test_onset_issues(spark):
    cues = spark.createDataFrame([(1, 1, 1000, 2000), (1, 2, 4000, 5000), (1, 3, 7000, 8000), (1, 4, 20_000, 21_000)], "clip_id long, phrase_id long, start_ms long, end_ms long")
    words = spans(spark, (500, 600), (3600, 3700), (7600, 7700))
    got = sorted((r.phrase_id, r.kind, r.t0_ms, r.t1_ms) for r in edges.onset_issues(cues, spans(spark, (1050, 1900)), words).collect())
    assert got == [(2, "late_start", 4000, 4400), (3, "early_start", 7000, 7600)]


def folded(levels, hop=30):
    """Hop by hop: state on or off, and how long it has been quiet."""
    peak, found, start, quiet = max(levels), [], None, 0
    for i, x in enumerate(levels):
        if start is None and x > max(0.001, 0.1 * peak):
            start, quiet = i, 0
        elif start is not None:
            quiet = quiet + 1 if x <= max(0.0005, 0.04 * peak) else 0
            if quiet * hop >= 150:
                found.append((start, i - quiet + 1))
                start = None
    found += [(start, len(levels))] if start is not None else []
    return sorted((s * hop, e * hop) for s, e in found if (e - s) * hop >= 250)


def test_energy_segments(spark):
    import random

    rng = random.Random(3)
    clips = {c: [rng.choice([0.0, 0.0, 0.03, 0.07, 0.5, 1.0]) * rng.choice([0, 1]) for _ in range(400)] for c in range(5)} | {9: [0.0] * 20}
    rows = spark.createDataFrame([(c, i, x) for c, xs in clips.items() for i, x in enumerate(xs)], "clip_id long, hop long, rms double")
    got = runs.energy_segments(rows, ["clip_id"], hops_per_bucket=50)
    assert got.columns == ["clip_id", "start_ms", "end_ms"]
    for c, xs in clips.items():
        own = got.filter(F.col("clip_id") == c).collect()
        assert sorted((r.start_ms, r.end_ms) for r in own) == (folded(xs) if max(xs) else [])
