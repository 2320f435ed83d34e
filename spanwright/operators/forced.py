"""Words of a known text placed in the frames of a clip: forced alignment over scores of symbols.

A text's letters and separators stand with a blank before, between and behind them. A path begins at the first blank and, from
frame to frame, stays or moves on by one; the path with the highest sum of scores wins. Clips of few frames are worked out many at
a time, a frame of each in step. Frames of a longer one stream through a task in order with the scores of the states as state; of
frames gone by it keeps the moves alone, a bit for each state of a block's stretch, and walks back over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import once

#: Milliseconds of a frame, frames of a block (a minute), letters that a block may be ahead of or behind its even share.
FRAME, BLOCK, MARGIN = 20, 3000, 80
#: Frames of a clip that is held whole, frames that are held together, and states and clips that are worked out in step.
HELD, TOGETHER, STATES, CLIPS = 8_192, 100_000, 16_384, 64
#: Between words.
SEPARATOR = "|"
_NEVER, _LOST = -1e30, -1e20


def letters_of(canon: Column, symbols: list[str]) -> Column:
    """The numbers of the letters of an array of words in their normal spelling, a separator between two; null if one is none of
    `symbols`, or if there is none. Symbol 0 is the blank. A word without letters keeps its separators."""
    known = F.create_map(*(x for k, s in enumerate(symbols) if k for x in (F.lit(s), F.lit(k))))
    each = F.filter(F.split(F.array_join(canon, SEPARATOR), ""), lambda c: c != "")
    found = F.transform(each, lambda c: F.try_element_at(known, c))
    return once(found, lambda x: F.when((F.size(x) > 0) & ~F.exists(x, lambda k: k.isNull()), x))


def _stretch(anchor: int, frame: int, frames: int, letters: int, block: int, margin: int) -> tuple[int, int]:
    """The letters that a block from `frame` on may be in."""
    share = max(1, round((min(frame + block, frames) - frame) / frames * letters))
    low = max(0, anchor - margin)
    return low, max(min(letters, anchor + share + margin), min(letters, low + 1))


class _Clip:
    """A clip's letters, the words that they are of, the number of its frames, and their scores as far as they are held."""

    def __init__(self, key: Any, letters: np.ndarray, words: pa.Array | None, frames: int) -> None:
        self.key, self.letters, self.words, self.frames = key, letters, words, frames
        self.scores: list[np.ndarray] = []


class _States:
    """Scores of the states of one clip, the stretch of letters that the current block may be in, and of all blocks so far
    which states the best paths have moved to, a bit each."""

    def __init__(self, letters: np.ndarray, block: int, margin: int) -> None:
        self.block, self.margin, self.letters, self.anchor = block, margin, letters, 0
        self.scores = np.full(2 * len(letters) + 1, _NEVER)
        self.scores[0] = 0.0
        self.moves: list[tuple[int, int, np.ndarray]] = []

    def open(self, frame: int, frames: int) -> None:
        self.low, self.high = _stretch(self.anchor, frame, frames, len(self.letters), self.block, self.margin)
        self.symbols = np.zeros(2 * (self.high - self.low) + 1, dtype=np.int64)
        self.symbols[1::2] = self.letters[self.low : self.high]
        self.own = self.scores[2 * self.low : 2 * self.high + 1]
        self.moved = np.zeros((min(self.block, frames - frame), len(self.own)), bool)
        self.next = np.full(len(self.own), _NEVER)

    def step(self, frame: int, scores: np.ndarray) -> None:
        here = scores[self.symbols]
        np.add(self.own[:-1], here[1:], out=self.next[1:])
        self.own += here
        np.greater(self.next, self.own, out=self.moved[frame % self.block])
        np.copyto(self.own, self.next, where=self.moved[frame % self.block])

    def close(self, frame: int) -> None:
        self.moves.append((frame - frame % self.block, 2 * self.low, np.packbits(self.moved, axis=1)))
        self.anchor = self.best() // 2

    def best(self) -> int:
        return 2 * self.low + int(self.own.argmax())

    def spans(self) -> Iterator[tuple[int, int, int]]:
        """(letter, first, last) of the best path, from its end."""
        at = self.best()
        if not self.scores[at] > _LOST:
            return
        last = first = -1
        for begin, low, bits in reversed(self.moves):
            moved = np.unpackbits(bits, axis=1).view(bool)
            for k in range(len(moved) - 1, -1, -1):
                first = begin + k
                last = first if last < 0 else last
                if 0 < at - low < moved.shape[1] and moved[k, at - low]:
                    if at % 2:
                        yield at // 2, first, last
                    at, last = at - 1, -1
        if at % 2 and last >= 0:
            yield at // 2, first, last


#: A clip, its first letter with frames, and the first and last frame of each letter from there on.
Found = tuple[_Clip, int, np.ndarray, np.ndarray]


def _streamed(pieces: Iterator[tuple[_Clip, np.ndarray]], block: int, margin: int) -> Iterator[Found]:
    """The letters' frames of clips whose scores come in pieces, each clip's in order."""
    held: list[_Clip] = []
    many = frame = 0
    own = state = None
    for clip, scores in pieces:
        if clip is not own:
            own, frame = clip, 0
            state = None if clip.frames <= HELD else _States(clip.letters, block, margin)
        if state is None:
            clip.scores.append(scores)
            frame, many = frame + len(scores), many + len(scores)
            if frame == clip.frames:
                held.append(clip)
                if many >= TOGETHER:
                    yield from _held(held, block, margin)
                    held, many = [], 0
            continue
        for p in scores:
            if frame % block == 0:
                state.open(frame, clip.frames)
            state.step(frame, p)
            frame += 1
            if frame % block == 0 or frame == clip.frames:
                state.close(frame - 1)
        if frame == clip.frames and (spans := list(state.spans())[::-1]):
            yield clip, spans[0][0], np.array([x[1] for x in spans]), np.array([x[2] for x in spans])
    yield from _held(held, block, margin)


def _held(clips: list[_Clip], block: int, margin: int) -> Iterator[Found]:
    """The same of clips that are held whole, those of about the same length together."""
    size = lambda c: 2 * min(len(c.letters), c.frames) + 1
    clips = sorted(clips, key=lambda c: (-c.frames, -len(c.letters)))
    own: list[_Clip] = []
    for clip in clips:
        if own and (len(own) == CLIPS or (len(own) + 1) * max(size(clip), *map(size, own)) > STATES):
            yield from _in_step(own, block, margin)
            own = []
        own.append(clip)
    if own:
        yield from _in_step(own, block, margin)


def _in_step(clips: list[_Clip], block: int, margin: int) -> Iterator[Found]:
    """The same of clips in falling order of their frames, by the rule of `_States`. States no path has reached yet are left out."""
    scores = [np.concatenate(c.scores) if len(c.scores) > 1 else c.scores[0] for c in clips]
    sums = [np.full(2 * len(c.letters) + 1, _NEVER) for c in clips]
    for own in sums:
        own[0] = 0.0
    best, blocks = np.zeros(len(clips), dtype=np.int64), []
    for begin in range(0, clips[0].frames, block):
        # states of all clips lie beside each other: state s of clip k at s * n + k
        n = sum(c.frames > begin for c in clips)
        lengths = np.array([min(block, c.frames - begin) for c in clips[:n]])
        steps, ends = int(lengths[0]), {}
        edges = [_stretch(int(best[k]) // 2, begin, c.frames, len(c.letters), block, margin) for k, c in enumerate(clips[:n])]
        stretches = [sums[k][2 * low : 2 * high + 1] for k, (low, high) in enumerate(edges)]
        top = max(int(np.flatnonzero(x > _LOST)[-1]) if (x > _LOST).any() else 0 for x in stretches)
        size = min(max(map(len, stretches)), top + steps + 1)
        sums_, symbols, p = np.full((size, n), _NEVER), np.zeros((size, n), dtype=np.intp), np.zeros((steps, scores[0].shape[1], n))
        for k, x in enumerate(stretches):
            sums_[: len(x), k] = x[:size]
            own = clips[k].letters[edges[k][0] : edges[k][1]][: size // 2]
            symbols[1 : 2 * len(own) : 2, k] = own
            p[: lengths[k], :, k] = scores[k][begin : begin + lengths[k]]
            ends.setdefault(int(lengths[k]) - 1, []).append(k)
        at, sums_, p = (symbols * n + np.arange(n)).ravel(), sums_.ravel(), p.reshape(steps, -1)
        here, next_, moved = np.empty(len(at)), np.empty(len(at)), np.zeros((steps, len(at)), bool)
        for f in range(steps):
            m = min(size, top + f + 2) * n
            stay, move = sums_[:m], next_[: m - n]
            np.take(p[f], at[:m], out=here[:m], mode="clip")
            np.add(stay[: m - n], here[n:m], out=move)
            np.add(stay, here[:m], out=stay)
            np.greater(move, stay[n:], out=moved[f, n:m])
            np.maximum(move, stay[n:], out=stay[n:])
            for k in ends.get(f, ()):
                stretches[k][:size] = sums_[k::n][: len(stretches[k])]
                best[k] = 2 * edges[k][0] + int(stretches[k].argmax())
        blocks.append((begin, lengths, edges, size, moved))
    state, moves = best.copy(), np.zeros((clips[0].frames, len(clips)), bool)
    for begin, lengths, edges, size, moved in reversed(blocks):
        n = len(lengths)
        low, high = np.array(edges).T
        # beyond a block's stretch a path stays, as the first state of a stretch does
        place = state[:n] - 2 * low
        at = np.where((place > 0) & (place <= 2 * (high - low)) & (place < size), place, 0) * n + np.arange(n)
        for f in range(len(moved) - 1, -1, -1):
            here = moved[f].take(at)
            if f >= lengths[-1]:
                here &= f < lengths
            moves[begin + f, :n] = here
            at -= here * n
        state[:n] -= moves[begin : begin + len(moved), :n].sum(axis=0)
    for k, c in enumerate(clips):
        if not sums[k][best[k]] > _LOST:
            continue
        # a path comes to states one after the other, so its moves tell where each begins
        on = np.flatnonzero(moves[: c.frames, k])
        first, last = np.append(0, on), np.append(on, c.frames) - 1
        skip = int(state[k] % 2 == 0 or last[0] < 0)
        skip += int((state[k] + skip) % 2 == 0)
        if skip < len(first):
            yield c, int(state[k] + skip) // 2, first[skip::2], last[skip::2]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Clip, np.ndarray]]:
    """Clips with their frames' scores, of rows in order: a clip's letters, then its frames."""
    clip = None
    for b in batches:
        p, letters = b.column("p"), b.column("letters")
        values, starts = p.values.to_numpy(zero_copy_only=False), p.offsets.to_numpy()
        keys, given = b.column("_clip").to_pylist(), letters.is_valid().to_numpy(zero_copy_only=False)
        bounds = [k for k in range(len(keys)) if k == 0 or given[k] or keys[k] != keys[k - 1]] + [len(keys)]
        for first, end in zip(bounds, bounds[1:], strict=False):
            if given[first]:
                words = b.column("canon")[first].values if "canon" in b.schema.names else None
                clip = _Clip(keys[first], letters[first].values.to_numpy(), words, b.column("frames")[first].as_py())
                first += 1
            if clip is not None and keys[end - 1] == clip.key and first < end:
                yield clip, values[starts[first] : starts[end]].reshape(end - first, -1)


def _rows(frames: DataFrame, texts: DataFrame, clip: str) -> DataFrame:
    """Each clip's letters and behind them its frames in order, dealt by clip; texts without letters are left out."""
    sizes = frames.groupBy(clip).agg(F.count("*").alias("frames"))
    own = texts.filter(F.size("letters") > 0).join(sizes, clip)
    # a clip's letters come before its frames; a join could send all frames around, which are many more than the table they are made of tells
    first = own.withColumnRenamed(clip, "_clip").withColumn("frame", F.lit(-1).cast("long"))
    rows = first.unionByName(frames.select(F.col(clip).alias("_clip"), F.col("frame").cast("long").alias("frame"), "p"), allowMissingColumns=True)
    return rows.repartition("_clip").sortWithinPartitions("_clip", "frame")


def _columns(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def letter_frames(frames: DataFrame, texts: DataFrame, clip: str, block: int = BLOCK, margin: int = MARGIN) -> DataFrame:
    """(clip, letter, first, last): the frames of each letter that the best path comes to, `letter` its place in the text.

    frames (clip, frame, p): frame counts from 0 without gaps, p are the scores of all symbols, as logarithms; texts (clip,
    letters): numbers of symbols, without null. Ties: a path that stays. In a block of `block` frames the path is looked for among its even
    share of the letters, `margin` more on either side, from where the block before it has ended best. The path may end at any state,
    as a clip may be cut. Clips of up to HELD frames are held until there are TOGETHER frames; of a longer one the letters, the scores
    of its states and the moves of its frames, as bits, are in a task's memory, the frames' scores are not."""
    schema = f"{clip} {dict(texts.dtypes)[clip]}, letter long, first long, last long"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, letter, first, last in _streamed(_pieces(batches), block, margin):
            yield _columns([[c.key] * len(first), np.arange(letter, letter + len(first)), first, last], out)

    return _rows(frames, texts.select(clip, "letters"), clip).mapInArrow(run, schema)


def _words(found: Iterator[Found], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of the words that letters' frames reach, if those are the first of their text."""
    keys, columns, many = [], [], 0
    for clip, letter, first, last in found:
        steps = pc.fill_null(pc.add(pc.utf8_length(clip.words), 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(steps) - steps
        end = begin + steps - 1
        idx = np.flatnonzero((steps > 1) & (begin < letter + len(first)) & (end > letter))
        # a word is reached only behind all before it
        if not len(idx) or len(idx) != idx[-1] + 1:
            continue
        n = len(idx)
        start = first[np.maximum(begin[:n] - letter, 0)] * FRAME
        until = (last[np.minimum(end[:n] - letter, len(last)) - 1] + 1) * FRAME
        keys += [clip.key] * n
        columns.append((idx, clip.words.slice(0, n), start, until))
        many += n
        if many >= 10_000:
            yield _columns([keys, *_joined(columns)], schema)
            keys, columns, many = [], [], 0
    if columns:
        yield _columns([keys, *_joined(columns)], schema)


def _joined(columns: list[tuple]) -> list:
    idx, words, start, until = zip(*columns, strict=True)
    return [np.concatenate(idx), pa.concat_arrays(words), np.concatenate(start), np.concatenate(until)]


#: Of a clip and its letters the number of its frames and, in pieces, their scores: a row a frame, a column a symbol.
Scores = Callable[[Any, np.ndarray], tuple[int, Iterator[np.ndarray]]]


def _scored(scores: Scores, clip: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[_Clip, np.ndarray]]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Clip, np.ndarray]]:
        for b in batches:
            letters, canon = b.column("letters"), b.column("canon")
            for k, key in enumerate(b.column(clip).to_pylist()):
                if key is not None and letters[k].is_valid:
                    numbers = letters[k].values.to_numpy()
                    n, pieces = scores(key, numbers)
                    own = _Clip(key, numbers, canon[k].values, n)
                    yield from ((own, p) for p in pieces)

    return read


def aligned_words(frames: DataFrame | Scores, texts: DataFrame, clip: str, symbols: list[str], block: int = BLOCK, margin: int = MARGIN) -> DataFrame:
    """(clip, idx, word, start_ms, end_ms): the words of each clip's text (clip, canon: array of words) that its frames reach.

    `frames` is a table as in `letter_frames`, or a function that scores a clip's frames in the task that has its text, so that they
    need not be dealt; texts then stay in the tasks that they are dealt to. Words behind the last one reached are left out; a text
    of which an earlier word has no frame, or with a symbol that is not
    among `symbols`, gets no row, nor does an empty text or a clip without frames. A word lasts from its first letter's first frame
    to its last letter's end, as far as it is reached. Repeated rows of a clip in `texts` or of a frame are not told apart: keys are to be distinct."""
    own = texts.select(clip, "canon", letters_of(F.col("canon"), symbols).alias("letters"))
    schema = f"{clip} {dict(texts.dtypes)[clip]}, idx long, word string, start_ms long, end_ms long"
    out, table = to_arrow_schema(StructType.fromDDL(schema)), isinstance(frames, DataFrame)
    read = _pieces if table else _scored(frames, clip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _words(_streamed(read(batches), block, margin), out)

    return (_rows(frames, own, clip) if table else own).mapInArrow(run, schema)
