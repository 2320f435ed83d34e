import pathlib
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanwright.llm import huffman, packing
from spanwright.llm.tokens import WordEncoder

ROOT = pathlib.Path(__file__).parents[2]
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_words_give_the_librarys_ids(library):
    encode = WordEncoder(PATH)
    odd = ["", "it's I'LL x'revel 12,3 a--b", "\x0b\x0cA\x1f B\x85C", "é ÀÉ ß µ ª º ×÷ ÿ Ÿ", "é ﬁ İ Σας", "<|endoftext|> a<|b", "a b", "''s 's'", "\x00\x7f~", "x" * 5000]
    for text in odd:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def want(rows, library, end):
    return [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [end]) for r in rows]


def checked(got, rows):
    assert sorted(map(str, rows)) == sorted(str((r.doc_id, np.frombuffer(r.ids, "<u4").tolist())) for r in got)
    at, last = 0, -1
    for r in got:
        assert r.start == at and r.ids_crc32 == zlib.crc32(r.ids) and r.n_tokens == len(r.ids) // 4
        assert (r.doc_id if r.doc_id is not None else -1) >= last
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else -1


def test_files_give_back_every_id(spark, odd, library, tmp_path):
    tokens = huffman.tokenize(odd, PATH, 2)
    huffman.write_token_files(tokens, str(tmp_path / "f"), 2)
    checked(huffman.read_token_files(spark, str(tmp_path / "f")).orderBy("start").collect(), want(odd.collect(), library, 2))


def test_one_doc_id_fills_several_ranges(spark, library, tmp_path):
    df = spark.createDataFrame([(5 if k % 2 else k, f"word {k} and more") for k in range(400)], "doc_id long, text string")
    huffman.write_token_files(huffman.tokenize(df, PATH, 2), str(tmp_path / "f"), 2)
    checked(huffman.read_token_files(spark, str(tmp_path / "f")).orderBy("start").collect(), want(df.collect(), library, 2))
    assert spark.read.parquet(str(tmp_path / "f/ranges")).count() == 4


def test_another_process_reads_the_path_alone(spark, odd, library, tmp_path):
    huffman.write_token_files(huffman.tokenize(odd, PATH, 2), str(tmp_path / "f"), 2)
    code = """
import sys
from pyspark.sql import SparkSession
from spanwright.llm import huffman
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
huffman.read_token_files(spark, sys.argv[1]).write.parquet(sys.argv[2])
"""
    subprocess.run([sys.executable, "-c", code, str(tmp_path / "f"), str(tmp_path / "got")], check=True, cwd=ROOT, timeout=200)
    checked(spark.read.parquet(str(tmp_path / "got")).orderBy("start").collect(), want(odd.collect(), library, 2))


def test_changed_blocks_are_refused():
    block = huffman.write_block(0, [1], [2], [b"\x01\x02"], [])
    table = huffman.decoding_table(huffman.code_lengths(np.array([3, 2, 1])))
    assert huffman.read_block(block, *table)[1] == [1]
    for bad in (block[:-1] + b"\x03", b"XXXX" + block[4:]):
        with pytest.raises(ValueError):
            huffman.read_block(bad, *table)


def test_no_documents(spark, nothing, tmp_path):
    huffman.write_token_files(huffman.tokenize(nothing, PATH, 2), str(tmp_path / "f"), 2)
    assert huffman.read_token_files(spark, str(tmp_path / "f")).count() == 0
    assert packing.pack_documents(nothing, PATH).count() == 0


def test_code_is_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(1)
    counts = rng.integers(1, 1000, 300)
    counts[7] = 0
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        cost += (x := heapq.heappop(heap) + heapq.heappop(heap))
        heapq.heappush(heap, x)
    assert int((huffman.code_lengths(counts) * counts).sum()) == cost
    steep = huffman.code_lengths(2 ** np.arange(40, dtype=np.int64))
    assert steep.max() == 16 and sum(2.0 ** -int(n) for n in steep) == 1
    assert huffman.code_lengths(np.array([0, 5])).tolist() == [0, 1]


def test_pieces_are_whole_and_bins_gapless(odd, library):
    rows = packing.pack_documents(odd, PATH, capacity=512, with_ids=True).toPandas()
    texts = sorted(map(str, want(odd.collect(), library, 1)))
    got = []
    for doc, g in rows[rows.doc_id.notna() & (rows.doc_id != 12)].sort_values("piece").groupby("doc_id"):
        assert g.start.tolist() == np.r_[0, g.length.cumsum()[:-1]].tolist()
        assert (g.length[:-1] == 512).all()
        got.append(str((int(doc), np.frombuffer(b"".join(g.ids), "<u4").tolist())))
    assert set(got) <= set(texts) and len(got) == len({r.doc_id for r in odd.collect()} - {None, 12})
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.r_[0, g.length.cumsum()[:-1]].tolist() and g.length.sum() <= 512
    bins = []
    for n in sorted(rows.length, reverse=True):  # first fit decreasing
        k = next((k for k, x in enumerate(bins) if x + n <= 512), len(bins))
        bins[k : k + 1] = [n + (bins[k] if k < len(bins) else 0)]
    assert rows.sequence_id.nunique() <= len(bins)


def test_fullest_equals_brute_force():
    from itertools import combinations

    rng = np.random.default_rng(2)
    for _ in range(60):
        items = [int(x) for x in rng.integers(1, 40, 8)]
        room = int(rng.integers(1, 120))
        counts = {n: items.count(n) for n in items}
        best = max(sum(c) for k in range(9) for c in combinations(items, k) if sum(c) <= room)
        got = packing.fullest(counts, room)
        assert sum(n * c for n, c in got) == best and all(c <= counts[n] for n, c in got)
