"""Ties that a query's SQL settles by the order of the rows."""

import datetime

import duckdb

from spanwright.plans import small


def test_the_first_of_equal_values_is_the_last_passage(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(k, at, 1, "signup" if k % 2 else "view", value) for k, value in enumerate([1.0, 7.0, 3.0, 7.0, 7.0])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    (card,) = small.card(spark, str(tmp_path)).collect()
    assert (card.passages, card.n_cues, card.score) == (2, 2, 7.0)


def test_missing_values_and_ids_and_hundredths_as_in_sql(spark, tmp_path):
    """Events without a value or an id are no last passage, and scores are rounded as SQL rounds doubles."""
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, 1, None), (2, 1, None), (3, 2, None), (4, 2, 5.0), (5, 2, float("nan")), (9, 3, -1.0), (None, 3, 7.0), (13, 4, 1.005), (15, 5, 1e308), (16, 6, None), (17, 6, 2.0), (18, 6, -2.675)]
    spark.createDataFrame([(k, at, c, "signup", v) for k, c, v in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    with duckdb.connect() as db:
        db.sql(f"create view events as from '{tmp_path}/events.parquet/*.parquet'")
        want = db.sql(f"select clip_id, passages, score, n_cues from ({small.SQL['result_card']})").fetchall()
    got = [tuple(r) for r in small.card(spark, str(tmp_path)).select("clip_id", "passages", "score", "n_cues").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 6
