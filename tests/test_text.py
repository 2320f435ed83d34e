"""Text functions, search, sources and streams."""

import json
import random
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanwright.functions import text
from spanwright.operators import runs, search
from spanwright.sources import subtitles
from spanwright.streaming import state


def values(spark, make, *given):
    df = spark.createDataFrame([(k, *(x if isinstance(x, tuple) else (x,))) for k, x in enumerate(given)], "k int, a string" if not isinstance(given[0], tuple) else "k int, a string, b string")
    return [r.v for r in df.select("k", make(F.col("a")).alias("v")).orderBy("k").collect()]


def test_text_functions(spark):
    assert values(spark, text.fold, "ٱلرَّحْمَـٰنِ ", "أإآؤئةى", None, "") == ["الرحمن", "اااويهي", None, ""]
    assert values(spark, text.fold_standard, "ٱلصَّلَوٰةَ") == ["الصلاه"]
    assert values(spark, text.words, " a b\tc ", "", None) == [["a", "b", "c"], [], []]
    assert values(spark, lambda c: text.reference(c), "2:255:7", "2:255", "x") == [[2, 255, 7], None, None]
    assert values(spark, text.ends_clause, "word.", 'end."', "--", "no", "a،") == [True, True, True, False, True]
    assert values(spark, text.media_type, "a/b.MP4", "x") == ["video/mp4", "application/octet-stream"]
    assert values(spark, text.valid_media_id, "a-Z_9", "a/b", "", None, "x" * 65, "x\n") == [True, False, False, False, False, False]
    assert values(spark, lambda c: text.clock(c.cast("long")), "0", "3723004", "-5", "360000000") == ["00:00:00,000", "01:02:03,004", "00:00:00,000", "100:00:00,000"]
    assert values(spark, lambda c: text.error_class(c.cast("int")), "402", "429", "503", "200") == ["permanent", "transient", "transient", None]
    assert "يا" in values(spark, text.word_forms, "يَٰأَيُّهَا")[0]


def test_similarity():
    assert search.ratio("", None) == 100.0 and search.ratio("abc", "abc") == 100.0 and search.ratio("ab", "cd") == 0.0
    rng = random.Random(3)
    for _ in range(50):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert search.ratio(a, b) == pytest.approx(200 * table[-1][-1] / (len(a) + len(b)))
        assert search.ratio(a, b) >= 100 * SequenceMatcher(None, a, b).ratio() - 1e-9


def test_alignment(spark):
    canon = [f"w{k}" for k in range(60)]
    heard = [*canon[5:20], "noise", *canon[22:40]]
    found = search.align_pair(heard, canon, {w: 1.0 for w in canon})
    assert found == [(k, 5 + k) for k in range(15)] + [(16 + k, 22 + k) for k in range(18)]
    assert search.align_pair(heard[:9], canon, {}) == []
    df = spark.createDataFrame([(1, heard, canon), (2, None, canon), (3, heard, None)], "id long, heard array<string>, canon array<string>")
    assert {r.id for r in search.banded_alignment(df, "id long").collect()} == {1}


def test_passages(spark):
    rng = random.Random(4)
    canon = [(k, " ".join(f"c{rng.randrange(10**6)}" for _ in range(30))) for k in range(5)]
    docs = [(0, "x y z " + canon[2][1] + " tail"), (1, " ".join(canon[3][1].split()[5:20])), (2, None), (3, "")]
    found = search.passage_runs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(canon, "item_id long, text string"))
    got = sorted((r.doc_id, r.item_id, r.doc_from, r.doc_to, r.canon_from, r.canon_to, r.matched) for r in found.collect())
    assert got == [(0, 2, 3, 33, 0, 30, 30), (1, 3, 0, 15, 5, 20, 15)]


def test_value_runs(spark):
    rows = [(1, k, v) for k, v in enumerate(["a", "a", None, None, "b", "a"])]
    got = runs.value_runs(spark.createDataFrame(rows, "k long, at long, v string"), ["k"], "at", "v", F.floor(F.col("at") / 2))
    assert sorted((r.first, r.last, r.v, r.n) for r in got.collect()) == [(0, 1, "a", 2), (2, 3, None, 2), (4, 4, "b", 1), (5, 5, "a", 1)]


def test_sources(spark, tmp_path):
    (tmp_path / "canon.json").write_text(json.dumps({"1:1": "a", "1:2": "b", "2:1": "c", "bad": "x"}))
    canon = subtitles.read_canon(spark, str(tmp_path / "canon.json"))
    assert sorted(map(tuple, subtitles.window_index(canon, 2).collect())) == [(1, 1, "a b")] and subtitles.window_index(canon).count() == 0
    lines = ["event: progress", "data: 1", "", "event: result", "data: {}"]
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(lines)], "stream_id string, seq long, line string")
    assert sorted((r.event, r.data) for r in subtitles.sent_events(df).collect()) == [("progress", "1"), ("result", "{}")]


def test_uploads(spark, tmp_path):
    assert state.apply_slices(0, [(0, 100, 300), (200, 100, 300), (100, 200, 300)], 1 << 20) == (300, 2, 1, True)
    assert state.apply_slices(300, [(0, 50, 100)], 1 << 20) == (50, 1, 0, False)
    assert state.apply_slices(0, [(0, 2000, 2000)], 1000) == (0, 0, 1, False)
    schema = "media_id string, seq long, offset long, size long, total long"
    spark.createDataFrame([("a", 0, 0, 100, 300), ("a", 1, 200, 100, 300), ("b", 0, 0, 10, 10)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("a", 2, 100, 200, 300)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    to = str(tmp_path / "out")
    query = state.uploads(stream).writeStream.outputMode("update").foreachBatch(lambda df, k: df.write.mode("append").parquet(to)).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(to).collect()
    assert {r.media_id for r in rows} == {"a", "b"} and any(r.media_id == "b" and r.complete for r in rows)
    assert max(r.accepted + r.rejected for r in rows if r.media_id == "a") == 3


def test_evictions(spark):
    files = [("old", 1, 700, True), ("new", 2, 700, True), ("young", 3, 100, False)]
    df = spark.createDataFrame(files, "path string, mtime long, size long, eligible boolean")
    assert [r.path for r in state.evictions(df, 900).collect()] == ["old"]
    assert state.evictions(df, 5000).count() == 0 and state.evictions(df.limit(0), 1).count() == 0


def test_contract(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).columns


def test_known_ends_of_clauses(spark):
    rows = spark.createDataFrame([("a b, c d. e f".split(), k, k + n) for k in range(7) for n in range(1, 4)], "w array<string>, a int, b int")
    ends = F.transform("w", text.ends_clause)
    w, a, b = map(F.col, "wab")
    got = rows.select(text.clause_span(w, a, b), text.clause_span(w, a, b, ends), text.trimmed(w, w, a, b), text.trimmed(w, w, a, b, ends)).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)


def test_lists_of_arrow_arrays():
    nested = pa.list_(pa.list_(pa.string()))
    for rows, kind in (([["a", None], None, [], ["b"]], pa.list_(pa.string())), ([[1, None], None, [2]], pa.list_(pa.int64())), ([[["a"], None, []], [], [["b"]]], nested)):
        assert text.lists(pa.array(rows, kind)) == rows and text.lists(pa.array(rows, kind)[1:]) == rows[1:]


def test_candidates_are_dealt_over_more_tasks_than_the_input_has(spark):
    docs = spark.createDataFrame([(k, "a b c d") for k in range(40)], "doc_id long, text string").repartition(12)
    canon = spark.createDataFrame([(1, "a b"), (2, "c x")], "item_id long, text string")
    found = search.idf_candidates(docs, canon)
    assert f", {12 * search.PARTS})" in found._jdf.queryExecution().toString()
    assert found.count() == 80
