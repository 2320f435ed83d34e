"""Sinks, sources and uploads."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from spanwright.functions import text
from spanwright.sources import subtitles
from spanwright.streaming import state


def test_canon_and_windows(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"1:1": "a", "1:2": "b", "1:3": "c", "1:4": "d", "2:1": "e", "bad": "x"}))
    canon = subtitles.read_canon(spark, str(tmp_path / "c.json"))
    assert canon.count() == 5
    assert sorted(r.text for r in subtitles.window_index(canon).collect()) == ["a b c", "b c d"]
    assert subtitles.read_canon(spark, str(tmp_path / "none.json"), needed=False).count() == 0
    with pytest.raises(AnalysisException):
        subtitles.read_canon(spark, str(tmp_path / "none.json")).count()


def test_results_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, 1.0)], "clip_id long, text string, score double")
    subtitles.write_results(df, str(tmp_path / "r"))
    assert sorted(map(tuple, spark.read.schema("text string, score double, clip_id long").json(str(tmp_path / "r")).select("clip_id", "text", "score").collect())) == [(1, "a", 0.5), (2, None, 1.0)]


def test_slices_without_a_check_of_their_offset():
    slices = [(0, 10, 30), (20, 10, 30), (10, 10, 30)]
    assert state.apply_slices(0, slices, 100) == (20, 2, 1, False)
    assert state.apply_slices(0, slices, 100, strict=False) == (30, 3, 0, True)


def test_last_status(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5)], "media_id string, batch long, stored long")
    assert sorted((r.media_id, r.stored) for r in state.latest_status(df).collect()) == [("a", 20), ("b", 5)]


def test_letters_and_vowels(spark):
    rows = [(1, "كتاب ١", "كِتَٰب"), (2, "abc", "قل"), (3, None, None), (4, "يٰأيها", "ى")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    got = {r.id: r for r in df.select("id", text.letters_only(F.col("a")).alias("letters"), text.has_long_vowel(F.col("b")).alias("long"), text.within_alphabet(F.col("a"), "كتاب|abc").alias("own"), F.array_join(text.word_forms(F.col("a")), ",").alias("forms")).collect()}
    assert got[1].letters == "كتاب" and got[2].letters == "" and got[1].long and not got[2].long and got[4].long and got[3].long is None
    assert got[1].own == "" and got[2].own == "abc"
    assert "يا" in got[4].forms.split(",") and len(got[4].forms.split(",")) >= 3


def test_spans_with_a_fallback(spark):
    df = spark.createDataFrame([(1, 5, 9, [1], [2]), (2, 5, 5, [3, 1], [4, 2]), (3, None, None, [], [])], "id long, a long, b long, s array<long>, e array<long>")
    got = {r.id: r.x for r in df.select("id", text.span_or_words(F.col("a"), F.col("b"), F.col("s"), F.col("e")).alias("x")).collect()}
    assert tuple(got[1]) == (5, 9) and tuple(got[2]) == (1, 4) and got[3] is None
