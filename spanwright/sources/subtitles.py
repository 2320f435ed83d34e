"""Subtitle sinks (SRT, WebVTT), the canon source and the server-sent-event source."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clock
from ..operators.ordered import Over, over_others
from .shared import staged

DAY = 86_400_000


def srt_blocks(cues: DataFrame, mark: str = ",", numbered: bool = True) -> DataFrame:
    """(clip_id, start_ms, end_ms, text) -> (clip_id, n, block), numbered in order of time, then text; rows with a null clip or time are no cues."""
    rows = staged(cues.select("clip_id", "start_ms", "end_ms", "text").dropna(subset=["clip_id", "start_ms", "end_ms"]).withColumn("_row", F.monotonically_increasing_id()), "cues")
    rows = over_others(rows, ["clip_id"], ["start_ms", "end_ms", "text", "_row"], F.floor(F.col("start_ms") / DAY), Over("n", "sum", F.lit(1)))
    rows = rows.withColumn("n", (F.coalesce("n", F.lit(0)) + 1).cast("long"))
    head = F.concat(F.col("n").cast("string"), F.lit("\n")) if numbered else F.lit("")
    block = F.concat(head, clock(F.col("start_ms"), mark), F.lit(" --> "), clock(F.col("end_ms"), mark), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return rows.select("clip_id", "n", block.alias("block"))


def documents(blocks: DataFrame, head: str = "") -> DataFrame:
    """(clip_id, body): the blocks of a clip, in order, a blank line between them."""
    parts = blocks.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("n", "block"))).alias("b"))
    return parts.select("clip_id", F.concat(F.lit(head), F.array_join(F.transform("b", lambda x: x["block"]), "\n")).alias("body"))


def srt(cues: DataFrame) -> DataFrame:
    return documents(srt_blocks(cues))


def vtt(cues: DataFrame) -> DataFrame:
    """Times have points; commas of the texts stay."""
    return documents(srt_blocks(cues, "."), "WEBVTT\n\n")


def in_language(own: Column, translation: Column, language: str) -> Column:
    """The text of a cue: `own`, the `translation` (own where there is none), or `both`, the translation on a line of its own."""
    own, translation = F.coalesce(own, F.lit("")), F.coalesce(translation, F.lit(""))
    if language == "own":
        return own
    if language == "translation":
        return F.when(F.trim(translation) == "", own).otherwise(translation)
    if language == "both":
        return F.when(F.trim(translation) == "", own).otherwise(F.concat(own, F.lit("\n"), translation))
    raise ValueError(f"no such language: {language}")


def write_results(results: DataFrame, path: str) -> None:
    """JSON lines, a folder for each clip."""
    results.write.partitionBy("clip_id").json(path)


def write_subtitles(bodies: DataFrame, path: str) -> None:
    """One text file part per task, partitioned by clip, with a byte order mark."""
    bodies.select("clip_id", F.concat(F.lit("﻿"), "body").alias("value")).write.partitionBy("clip_id").text(path)


def read_canon(spark: SparkSession, path: str, needed: bool = True) -> DataFrame:
    """JSON of "chapter:verse" -> text as (chapter, verse, text); a file that isn't there is an error, or if it isn't needed (a translation) an empty table."""
    try:
        rows = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if needed or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "chapter int, verse int, text string")
    rows = rows.select(F.explode(F.from_json("value", "map<string,string>")).alias("ref", "text"))
    cut = F.split("ref", ":")
    return rows.filter(F.col("ref").rlike(r"^\d{1,9}:\d{1,9}$")).select(cut[0].cast("int").alias("chapter"), cut[1].cast("int").alias("verse"), "text")


def window_index(canon: DataFrame, size: int = 3) -> DataFrame:
    """(chapter, verse, text): each verse with the next size - 1 of its chapter; verses with fewer behind them have none."""
    over = Window.partitionBy("chapter").orderBy("verse").rowsBetween(0, size - 1)
    rows = canon.select("chapter", "verse", F.collect_list("text").over(over).alias("t")).filter(F.size("t") == size)
    return rows.select("chapter", "verse", F.array_join("t", " ").alias("text"))


def sent_events(lines: DataFrame) -> DataFrame:
    """(stream_id, seq, line) of server-sent events -> (stream_id, seq, event, data), a row per data line; the event line before it names it."""
    over = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(F.col("line").startswith("event:"), F.trim(F.substring("line", 7, 1 << 20)))
    rows = lines.withColumn("event", F.last(name, ignorenulls=True).over(over))
    return rows.filter(F.col("line").startswith("data:")).select("stream_id", "seq", F.coalesce("event", F.lit("message")).alias("event"), F.trim(F.expr("substring(line, 6)")).alias("data"))
