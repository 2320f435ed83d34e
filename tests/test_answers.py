"""An aligner's answers against known cases."""

from spanwright.operators import answers
from spanwright.operators.answers import Opening

OPENINGS = [
    Opening("seek", 1, 0, "I seek help now here", "seeking", "isti", ("0:1",)),
    Opening("name", 1, 1, "in the name", "naming", "basmala", ("0:0", "0:2")),
    Opening("great", 1, 0, "God is", "greatest"),
]
VERSES = [(1, 1, "in the name".split(), "naming".split()), (2, 1, "God is light of all, and more".split(), "one two three, four five six seven".split()), (2, 2, "so it be".split(), [])]
SEGMENT = "clip_id long, seg long, kind string, special string, from_ms long"
WORD = "clip_id long, seg long, w long, location string, start_ms long, end_ms long"
VERSE = "chapter int, verse int, canon array<string>, translation array<string>"


def read(spark, segments, words):
    got = answers.read_answer(spark.createDataFrame(segments, SEGMENT), spark.createDataFrame(words, WORD), spark.createDataFrame(VERSES, VERSE), OPENINGS)
    pieces = sorted(tuple(r) for r in got.pieces.select("clip_id", "seg", "piece", "name", "chapter", "verse", "first", "last", "start_ms", "end_ms", "text", "translation").collect())
    return pieces, sorted(tuple(r) for r in got.words.collect()), dict(tuple(r) for r in got.problems.collect())


def run(clip, seg, *locations, step=100):
    return [(clip, seg, k, x, k * step, k * step + 80) for k, x in enumerate(locations)]


def test_pieces_repeats_and_trims(spark):
    words = run(1, 0, "2:1:3", "2:1:4", "2:2:1", "2:1:3", "2:1:4", "2:1:5") + [(1, 1, 0, "2:2:2", 50, 20), (1, 1, 1, "2:2:1", 10, 40)]
    pieces, spoken, problems = read(spark, [(1, 0, None, None, 1000), (1, 1, "quran", None, 5000), (1, 2, "quran", None, 9000)], words)
    assert problems == {}
    assert pieces == [
        (1, 0, 0, None, 2, 1, 2, 4, 1000, 1180, "light of", "one two three, four five six seven"),
        (1, 0, 1, None, 2, 2, 0, 1, 1200, 1280, "so", ""),
        (1, 0, 2, None, 2, 1, 2, 5, 1300, 1580, "light of all,", "one two three, four five six seven"),
        (1, 1, 0, None, 2, 2, 0, 2, 5010, 5050, "so it", ""),
    ]
    assert [w[3:6] for w in spoken if w[1] == 1] == [(0, 1, "it"), (1, 0, "so")] and (1, 1, 0, 0, 1, "it", 5050, 5050) in spoken


def test_special_segments(spark):
    named = lambda ps: [(p[0], p[2], p[3], p[6], p[7]) for p in ps]
    segments = [(c, 0, " Special", s, 0) for c, s in enumerate(["Isti'adha", "Basmala", "isti+basmala", "isti+basmala", "isti+basmala", None, None, "other"])]
    words = run(0, 0, "x", None) + run(1, 0, "0:0:1") + run(2, 0, "0:1:1", "0:1:2", "0:0:1") + run(3, 0, *["a"] * 9) + run(4, 0, *["a"] * 8) + run(5, 0, "0:1:1") + run(6, 0, "0:2:1", "0:1:1") + run(7, 0, "5:5:1")
    pieces, spoken, problems = read(spark, segments, words)
    assert problems == {7: "special"}
    assert named(pieces) == [(0, 0, "seek", 0, 2), (1, 1, "name", 0, 1), (2, 0, "seek", 0, 2), (2, 1, "name", 0, 1), (3, 0, "seek", 0, 5), (3, 1, "name", 0, 4), (4, 1, "name", 0, 8), (5, 0, "seek", 0, 1), (6, 0, "seek", 0, 1), (6, 1, "name", 0, 1)]
    assert [w[5] for w in spoken if w[0] == 3] == ["I", "seek", "help", "now", "here", "in", "the", "name", ""]
    assert pieces[0][4:6] == (1, 0) and pieces[1][4:6] == (1, 1) and pieces[1][10:] == ("in the name", "naming")


def test_first_piece_is_retagged_alone(spark):
    segments = [(1, 0, "quran", None, 0), (1, 1, "quran", None, 5000), (2, 0, "quran", None, 900), (2, 1, "quran", None, 0), (3, 0, "quran", None, 0)]
    words = run(1, 0, "2:1:1", "2:1:2") + run(1, 1, "2:1:1", "2:1:2") + run(2, 0, "2:1:1", "2:1:2") + run(2, 1, "2:2:1") + run(3, 0, "2:1:1", "2:1:2", "2:1:3")
    pieces, spoken, _ = read(spark, segments, words)
    assert [(p[0], p[1], p[3], p[4], p[5], p[10], p[11]) for p in pieces if p[3]] == [(1, 0, "great", 1, 0, "God is", "greatest")]
    assert len(pieces) == 5 and [w[4:6] for w in spoken if w[:2] == (1, 0)] == [(0, "God"), (1, "is")]


def test_problems(spark):
    segments = [(c, s, "quran", None, 0) for c in range(7) for s in (0, 1)]
    good = [w for c in range(6) for w in run(c, 0, "2:2:1")]
    bad = [(0, 1, 0, "2:2", 0, 9), (1, 1, 0, "0:2:1", 0, 9), (2, 1, 0, "2:2:4", 0, 9), (3, 1, 0, "2:2:0", 0, 9), (4, 1, 0, "2:2:1", None, 9), (4, 1, 1, "x", 0, 9), (5, 1, 0, "9:9:1", 0, 9), (8, 0, 0, "2:2:1", 0, 9)]
    pieces, _, problems = read(spark, segments, good + bad)
    assert pieces == [] and problems == {0: "location", 1: "chapter", 2: "numbering", 3: "numbering", 4: "timing", 5: "numbering", 6: "empty"}
    assert read(spark, [], []) == ([], [], {})
