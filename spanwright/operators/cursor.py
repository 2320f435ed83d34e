"""Chunks of a clip placed in its passage by a cursor that only moves forward.

Where a chunk goes hangs on the cursor that the chunks before it have left: a clip's chunks stream through a task with the
cursor as state. For clips too long for that, a chunk is a map from the cursor before it to that after it (`chunk_moves`), and
maps are composed along the clip by doubling (`composed`)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged
from .ordered import carried
from .search import ratios

#: A chunk is looked for in as many places as it has words and WIDER ones, LEAST at least, and placed from a similarity of ALIKE on.
WIDER, LEAST, ALIKE = 2, 8, 55.0


def composed(maps: DataFrame, key: str, order: str, to: str) -> DataFrame:
    """maps with `to`, an array m that sends a state s to m[s], replaced by the composition of all maps of the key up to
    and with this row; `order` counts from 0 without gaps. Each of log n rounds doubles how many rows a map stands for."""
    step, most = 1, maps.agg(F.max(order)).first()[0]
    while most is not None and step <= most:
        before = maps.select(key, (F.col(order) + step).alias(order), F.col(to).alias("_before"))
        joined = maps.join(before, [key, order], "left")
        both = F.transform("_before", lambda s: F.get(F.col(to), s))
        maps = staged(joined.withColumn(to, F.coalesce(both, F.col(to))).select(*maps.columns), "composed")
        step *= 2
    return maps


def chunk_moves(chunks: DataFrame, clip: str, order: str) -> DataFrame:
    """(clip, order, w, canon) -> (clip, order, moves, places): for each cursor from 0 to the canon's end, the cursor after
    the chunk, and the place that it gets, -1 for none.

    Of the places from the cursor on the one whose words, as many as the chunk's, are most similar is taken; ties: the
    first. A chunk without words moves nothing."""
    kinds = dict(chunks.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            moves, places = [], []
            for w, canon in zip(f["w"], f["canon"], strict=True):
                w, canon = list(w) if w is not None else [], list(canon) if canon is not None else []
                n, m = len(w), len(canon)
                to, at = np.arange(m + 1), np.full(m + 1, -1)
                if n and m:
                    score = np.array(list(ratios(" ".join(w), (" ".join(canon[k : k + n]) for k in range(m)))))
                    for c in range(m):
                        k = c + int(score[c : c + max(n + WIDER, LEAST)].argmax())
                        if score[k] >= ALIKE:
                            at[c], to[c] = k, max(c, min(k + n, m))
                moves.append(to.tolist())
                places.append(at.tolist())
            yield pd.DataFrame({clip: f[clip], order: f[order], "moves": moves, "places": places})

    return chunks.select(clip, order, "w", "canon").mapInPandas(run, f"{clip} {kinds[clip]}, {order} {kinds[order]}, moves array<int>, places array<int>")


def placed_chunks(chunks: DataFrame, clip: str, order: str, *more: str) -> DataFrame:
    """(clip, order, w, canon, ...) -> (clip, order, more, first, last): the chunks that have a place among their canon's words.

    The chunks of a clip stream in order with the cursor as state, so a chunk is compared with the places about that cursor
    alone; `chunk_moves` is the same rule for every cursor."""
    kinds = dict(chunks.dtypes)
    kept = [clip, order, *more]

    def step(cursor: list[int], r: dict) -> Iterable[tuple]:
        w, canon = r["w"] or [], r["canon"] or []
        n, m, c = len(w), len(canon), cursor[0]
        if not n or c >= m:
            return []
        score = list(ratios(" ".join(w), (" ".join(canon[k : k + n]) for k in range(c, min(m, c + max(n + WIDER, LEAST))))))
        best = max(score)
        if best < ALIKE:
            return []
        k = c + score.index(best)
        cursor[0] = max(c, min(k + n, m))
        return [(*(r[x] for x in kept), k, min(k + n, m))]

    rows = chunks.select(*kept, "w", "canon").dropna(subset=[clip, order])
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return carried(rows, [clip], [F.col(order)], lambda: [0], step, ", ".join(f"{x} {kinds[x]}" for x in kept) + ", first int, last int", parts)


def passage_segments(chunks: DataFrame, clip: str, order: str) -> DataFrame:
    """(clip, order, w, canon, verses, start_ms, end_ms) -> (clip, verse, start_ms, end_ms), verses being that of each canon word.

    A chunk belongs to the verse that most of its canon words are of; ties: the earlier. A verse lasts from its first chunk's
    start to its last one's end."""
    placed = placed_chunks(chunks, clip, order, "verses", "start_ms", "end_ms")
    own = F.slice("verses", F.col("first") + 1, F.col("last") - F.col("first"))
    rows = placed.withColumn("own", own)
    tally = F.transform(F.array_distinct("own"), lambda v: F.struct(F.size(F.filter("own", lambda x: x == v)).alias("n"), (-F.array_position("own", v)).alias("at"), v.alias("verse")))
    rows = rows.withColumn("verse", F.array_max(tally)["verse"])
    return rows.groupBy(clip, "verse").agg(F.min_by("start_ms", order).alias("start_ms"), F.max_by("end_ms", order).alias("end_ms"))
