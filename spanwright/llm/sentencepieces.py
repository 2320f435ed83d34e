"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts
from .tokens import _Cache

SPACE = "▁"
#: How much worse than the worst piece a character without a piece is. Fixed value.
PENALTY = 10.0
#: Longer stretches are encoded without the cache.
CACHED = 64


class Pieces:
    """A SentencePiece model file: text -> ids of the segmentation with the highest sum of piece scores, and back.

    For Unigram models this is the library's own segmentation. A BPE model's scores are ranks of merges; the highest sum of them is
    a segmentation into the same pieces, but not the one that its merges lead to (README has figures). Spaces become SPACE
    and one is put first, as the model's files ask for; nothing else is normalised. A character without a piece falls
    back to its bytes, and so does SPACE itself where a text has it, so decoding gives every text back. Of segmentations
    with equal sums the one whose last differing piece is longer wins."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.bytes, self.surface, low, inside = [0] * 256, [], 0.0, set()
        cuttable = True
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.bytes[int(piece[3:-1], 16)] = k
                self.surface.append(bytes([int(piece[3:-1], 16)]))
                continue
            self.surface.append(b"" if sp.is_control(k) or sp.is_unknown(k) else piece.replace(SPACE, " ").encode())
            if sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k):
                continue
            self.automaton.add_word(piece, (len(piece), sp.get_score(k), k))
            low = min(low, sp.get_score(k))
            inside |= set(piece) if len(piece) > 1 else set()
            cuttable &= SPACE not in piece.lstrip(SPACE)
        self.automaton.make_automaton()
        self.unknown = low - PENALTY
        # no piece reaches over the start of a run of spaces, or over a character that no longer piece has
        self.stretches = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if cuttable else "(?s).+")
        self.parts = re.compile(f"[{''.join(map(re.escape, sorted(inside)))}]+|(?s:.)")
        part = _Cache(lambda s: np.array(self.viterbi(s), "<u4").tobytes())
        self._part = lambda s: part[s] if len(s) <= CACHED else np.array(self.viterbi(s), "<u4").tobytes()
        self._known = _Cache(self._stretch)

    def _stretch(self, stretch: str) -> bytes:
        return b"".join(map(self._part, self.parts.findall(stretch)))

    def viterbi(self, s: str) -> list[int]:
        """One pass over the automaton's matches in order of their ends, longest first (each match and then what its
        output links give): each relaxes the best score at its end."""
        n = len(s)
        best, back, step = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        done, alone = 0, [False] * (n + 1)

        def settle(upto: int) -> None:  # a character without a piece of its own can stand for its bytes
            nonlocal done
            while done < upto:
                done += 1
                if not alone[done] and best[done - 1] + self.unknown > best[done]:
                    best[done], back[done], step[done] = best[done - 1] + self.unknown, done - 1, -1

        for end, (size, score, k) in self.automaton.iter(s):
            end += 1
            settle(end - 1)
            alone[end] |= size == 1
            score += best[end - size]
            if score > best[end]:
                best[end], back[end], step[end] = score, end - size, k
        settle(n)
        out = []
        while n:
            out += [step[n]] if step[n] >= 0 else [self.bytes[b] for b in reversed(s[back[n] : n].encode("utf-8", "surrogatepass"))]
            n = back[n]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if SPACE in text:
            mark = np.array([self.bytes[b] for b in SPACE.encode()], "<u4").tobytes()
            head, *parts = text.split(SPACE)
            return (self.encode(head) or self._stretches(SPACE)) + b"".join(mark + self._stretches(x.replace(" ", SPACE)) for x in parts)
        return self._stretches(SPACE + text.replace(" ", SPACE))

    def _stretches(self, text: str) -> bytes:
        known, stretch = self._known, self._stretch
        return b"".join([known[s] if len(s) <= CACHED else stretch(s) for s in self.stretches.findall(text)])

    def decode(self, ids: bytes) -> str:
        surface = self.surface
        return b"".join([surface[k] for k in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")[1:]


_workers: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _workers:
        _workers[path] = Pieces(path)
    return _workers[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, ids): one row per row, whole texts, however long; a null or empty text has no ids.

    Repeated rows stay; an empty table gives no rows; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(own.encode, b.column(1).to_pylist())), pa.binary())], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, ...) -> (doc_id, text); a null is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(x or b"") for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op5(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit), and whether decoding gives the text back."""
    import public_tokenizers

    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for b in batches:
            given = b.column(1).to_pylist()
            ids = list(map(own.encode, given))
            back = [own.decode(x) == t for x, t in zip(ids, given, strict=True)]
            cols = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(back)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return texts(table(spark, sf_dir, "documents")).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
