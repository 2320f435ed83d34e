import random

import numpy as np
import public_tokenizers
import pytest

from spanwright.llm import sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return sentencepieces.Pieces(PATH)


def slow(own, s):
    """The highest sum of scores over all segmentations, by a plain table."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PATH)
    n, best = len(s), [0.0]
    for end in range(1, n + 1):
        here = []
        for start in range(max(0, end - 20), end):
            k = sp.piece_to_id(s[start:end])
            if k != sp.unk_id() and not sp.is_byte(k) and not sp.is_control(k):
                here.append(best[start] + sp.get_score(k))
        k = sp.piece_to_id(s[end - 1])
        if k == sp.unk_id():
            here.append(best[end - 1] + own.unknown)
        best.append(max(here))
    return best[n]


def score(own, s, ids):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PATH)
    total, raw = 0.0, 0
    for k in ids:
        if sp.is_byte(k):
            raw += 1
        else:
            total += sp.get_score(k)
    unknown = sum(1 for c in s if sp.piece_to_id(c) == sp.unk_id())
    assert raw == sum(len(c.encode()) for c in s if sp.piece_to_id(c) == sp.unk_id())
    return total + unknown * own.unknown


def test_best_of_all_segmentations(own):
    rng = random.Random(4)
    words = ["the", "inter", "national", "öffnung", "naïve", "漢字", "\n", "x", "🙂", "  ", "unbe", "liev", "able"]
    for _ in range(40):
        text = "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(8))
        s = sentencepieces.SPACE + text.replace(" ", sentencepieces.SPACE)
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert score(own, s, ids) == pytest.approx(slow(own, s))
        assert own.decode(own.encode(text)) == text


def test_round_trip(odd, nothing):
    back = sentencepieces.decode(sentencepieces.encode(odd, PATH), PATH)
    assert sorted(str((r.doc_id, r.text)) for r in back.collect()) == sorted(str((r.doc_id, r.text or "")) for r in odd.collect())
    assert sentencepieces.encode(nothing, PATH).count() == 0


def field(number, value):
    """One field of a protocol buffer."""
    import struct

    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    return varint(number << 3) + varint(value)


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """A Unigram model file written by hand: pieces with scores of their own, and bytes to fall back to."""
    rng = random.Random(7)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    own = {"▁"} | set("abcdeñ") | {"".join(rng.choice("▁abcdeñ") if k else rng.choice("▁abcde") for k in range(rng.randrange(2, 7))) for _ in range(400)}
    own = {p for p in own if "▁" not in p[1:]}
    pieces += [(p, -rng.uniform(2, 12), 1) for p in sorted(own)]
    model = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, kind)) for p, s, kind in pieces)
    trainer = field(3, 1) + field(4, len(pieces)) + field(35, 1)
    normalizer = field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)
    path = tmp_path_factory.mktemp("unigram") / "own.model"
    path.write_bytes(model + field(2, trainer) + field(3, normalizer))
    return str(path)


def test_unigram_ids_are_the_librarys(unigram):
    from sentencepiece import SentencePieceProcessor

    sp, mine, rng = SentencePieceProcessor(model_file=unigram), sentencepieces.Pieces(unigram), random.Random(8)
    texts = ["".join(rng.choice("aabbccddeeñ  xz漢") for _ in range(rng.randrange(1, 200))) for _ in range(300)] + ["a", " ", "  a  b  ", "abc" * 500, "漢字", "\n a\tb"]
    different = 0
    for text in texts:
        ids = np.frombuffer(mine.encode(text), "<u4").tolist()
        different += ids != sp.encode(text)
        assert mine.decode(np.array(ids, "<u4").tobytes()) == text
    assert different == 0


def test_every_text_comes_back(own, unigram):
    for model in (own, sentencepieces.Pieces(unigram)):
        for text in ["a▁b", "▁", "▁▁ a", " ▁ ", "x ▁y▁", "漢▁字 \n", ""]:
            assert model.decode(model.encode(text)) == text
