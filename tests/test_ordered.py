"""Values over a key's other rows: keys of few rows as one window, large keys dealt over buckets, with the same results."""

import random

import pytest
from pyspark.sql import functions as F

from spanwright.operators import cues, edges, intervals, ordered
from spanwright.operators.ordered import Over

SPAN = "clip_id long, start_ms long, end_ms long"


def rows_of(seed, n=120, clips=4):
    rng = random.Random(seed)
    starts = [(rng.randrange(clips), rng.randrange(4000) * 60_000) for _ in range(n)]
    return [(c, s, s + rng.choice([-5, 0, 100, 60_000, 3_600_000])) for c, s in starts]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("whole", [True, False])
def test_each_value(spark, whole):
    rows = [(c, k, (k * 7 + c) % 11) for c in range(3) for k in range(9)] + [(3, 0, None)]
    df = spark.createDataFrame(rows, "c long, k long, x long")
    x = F.col("x")
    got = ordered.over_others(df, ["c"], ["k"], F.floor(F.col("k") / 3), Over("m", "max", x), Over("s", "sum", x), Over("low", "min", x, later=True), Over("n", "next", x), whole=whole)
    want = set()
    for c, k, own in rows:
        before, behind = ([r[2] for r in rows if r[0] == c and t(r[1], k)] for t in (int.__lt__, int.__gt__))
        want.add((c, k, own, max(before, default=None), sum(before) if before else None, min(behind, default=None), behind[0] if behind else None))
    assert {tuple(r) for r in got.collect()} == want


def test_large_keys_are_told(spark, monkeypatch):
    df = spark.range(50).selectExpr("id % 10 as c", "id as k")
    assert ordered.few(df, ["c"]) and ordered.few(df.limit(0), ["c"])
    monkeypatch.setattr(ordered, "WHOLE", 4)
    assert not ordered.few(df, ["c"])


def test_few_rows_a_key_are_dealt_once(spark):
    """Runs, the gaps between them and what is next to a point take one shuffle each, whatever the number of steps."""
    spans = spark.createDataFrame(rows_of(1), SPAN)
    points = spans.select("clip_id", F.col("start_ms").alias("t_ms"))
    for df in (intervals.merge(spans, ["clip_id"], 1000), intervals.gaps(spans, ["clip_id"], 250), intervals.subtract(spans, spans.limit(9), ["clip_id"], 300), intervals.nearest(points, points, ["clip_id"], 600)):
        assert exchanges(df) == 1


def test_large_and_small_keys_give_the_same(spark, monkeypatch):
    spans, more = (spark.createDataFrame(rows_of(k), SPAN) for k in (2, 3))
    texts = more.withColumn("text", F.concat_ws(" ", "start_ms", "end_ms"))
    phrases = more.withColumn("phrase_id", F.col("start_ms") * 10 + F.col("clip_id")).dropDuplicates(["phrase_id"])
    points = more.select("clip_id", "end_ms", F.col("start_ms").alias("t_ms"))

    silence = intervals.gaps(spans, ["clip_id"], 250)
    words = spark.createDataFrame([(c, k, 60_000 * k, 60_000 * k + 50_000) for c in range(3) for k in range(0, 4000, 9)], "clip_id long, idx long, start_ms long, end_ms long")

    def run():
        found = [
            intervals.merge(spans, ["clip_id"], 1000),
            intervals.gaps(spans, ["clip_id"], 250),
            intervals.subtract(spans, more, ["clip_id"], 300),
            intervals.coverage(spans, more, ["clip_id"]),
            intervals.nearest(points, spans.select("clip_id", F.col("start_ms").alias("t_ms")), ["clip_id"], 600_000),
            cues.audit(texts, spans),
            cues.show(texts.dropDuplicates(["clip_id", "start_ms", "end_ms"]), silence),
            cues.trim_overhang(texts, spans),
            cues.phrases(words, silence),
            cues.phrases(words, None),
            edges.onset_issues(phrases, spans, more.withColumn("start_ms", F.col("start_ms") + 700), 10**9),
        ]
        return [sorted(map(str, df.collect())) for df in found]

    small = run()
    monkeypatch.setattr(ordered, "WHOLE", 0)
    assert run() == small and all(small)


def test_texts_of_equal_times_have_an_order(spark):
    """Cues that begin and end together show their texts in one order, however they are dealt."""
    rows = [(1, 1000, 1020, t) for t in "cabed"] + [(1, 5000, 6000, "z")]
    df = spark.createDataFrame(rows, SPAN + ", text string")
    none = spark.createDataFrame([], SPAN)
    for own in (df.coalesce(1), df.orderBy(F.desc("text")).coalesce(1), df.repartition(3, "text")):
        assert [r.text for r in cues.show(own, none).orderBy("start_ms").collect()] == ["a b c d e", "z"]


def test_spans_that_a_row_meets(spark):
    rows = spark.createDataFrame([(1, 0, 50, 250), (1, 1, 400, 300), (1, 2, None, 9), (2, 3, 0, 10)], "c long, k long, low long, high long")
    spans = spark.createDataFrame([(1, 0, 60), (1, 90, 210), (1, 250, 900), (3, 0, 9)], "c long, start_ms long, end_ms long")
    ranges = [(F.col("low"), F.col("high")), (F.col("low") + 400, F.col("low") + 500)]
    for dealt, width in ((None, 100), (["c"], 10**6)):
        got = intervals.met(rows, spans, ["c"], ranges, lambda held, a, b, shared: {"n": F.count(held(a)), "s": F.sum(held(shared)), "first": F.min(held(a))}, 0, dealt, width)
        assert {tuple(r)[1:] for r in got.collect()} == {(0, 50, 250, 3, 230, 0), (1, 400, 300, 1, 100, 250), (2, None, 9, 0, None, None), (3, 0, 10, 0, None, None)}
