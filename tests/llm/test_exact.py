import hashlib
import random
import re
from collections import defaultdict

import pytest

from spanwright.llm import exact


def slow_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), 1 << 70 if r.doc_id is None else r.doc_id, r))
    return {k: sorted(v, key=lambda x: x[:2]) for k, v in groups.items()}


@pytest.mark.parametrize("held", [exact.HELD, 100, 3000])
def test_equals_brute_force(odd, nothing, held):
    want, kept = [], 0
    groups = slow_groups(odd.select("doc_id", "text").collect())
    for key, own in groups.items():
        want += [str((r.doc_id, own[0][2].doc_id, len(own), hashlib.sha256(key.encode()).hexdigest())) for *_, r in own]
    got = exact.exact_groups(odd, held).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == sorted(want)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept) and len({r.text_sha256 for r in kept}) == len(groups)
    assert exact.exact_groups(nothing).count() == 0


@pytest.mark.parametrize("held", [exact.HELD, 100])
def test_stage_keeps_one_row_of_each_group(odd, nothing, held):
    got = exact.exact_stage(odd, held)
    assert got.dtypes == odd.dtypes
    rows = got.collect()
    want = slow_groups(odd.collect())
    assert len(rows) == len(want)
    for r in rows:
        best = want[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")][0][2]
        assert (r.doc_id, len(r.text or "")) == (best.doc_id, len(best.text or ""))
    assert exact.exact_stage(nothing).count() == 0


def test_doc_ids_that_repeat(spark):
    rows = [(5, "alpha beta  "), (5, "gamma delta"), (3, "gamma delta"), (9, "alpha beta"), (None, "x"), (None, "x"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, exact.exact_stage(df).collect()), key=str) == [(3, "gamma delta"), (5, "alpha beta  "), (None, "x")]
    kept = [(r.doc_id, r.group_size) for r in exact.exact_groups(df).collect() if r.kept]
    assert sorted(kept, key=str) == [(3, 2), (5, 2), (None, 3)]


def test_strings_of_one_part_and_one_hash_are_told_apart(spark, monkeypatch):
    # every string has the same short hash, so tries alone tell them apart
    monkeypatch.setattr(exact.xxhash, "xxh3_64_intdigest", lambda key: 7)
    trie = exact.PatriciaTrie(exact._lesser)
    texts = [f"the same beginning {k % 50:02d} and the same end" for k in range(200)]
    owners = {}
    for k, t in enumerate(texts):
        assert exact.part_of(t.encode(), 64) == (6, 7)
        owners[t] = trie.add(t.encode(), [-len(t), k, t.encode(), None])
    assert len(dict(trie.strings())) == 50 and trie.branches() >= 5
    assert {o[1] for _, o in trie.strings()} == set(range(50))


def slow_trie(keys):
    want = {}
    for i, key in enumerate(keys):
        want[key] = min(want.get(key, (0, i)), (0, i))
    return want


def test_trie_keeps_every_string():
    rng = random.Random(1)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) for _ in range(3000)]
    trie = exact.PatriciaTrie(exact._lesser)
    for i, key in enumerate(keys):
        trie.add(key, [0, i, b""])
    assert {k: (o[0], o[1]) for k, o in trie.strings()} == slow_trie(keys)
    assert trie.size == sum(len(n.label) for n in exact._nodes(trie.root))
    start, out = trie.spill()
    assert out and all(k.startswith(start) for k, _ in out) and not any(k.startswith(start) for k, _ in trie.strings())
    assert trie.size == sum(len(n.label) for n in exact._nodes(trie.root))
    rest = dict(trie.strings()) | dict(out)
    assert set(rest) == set(keys)


def test_spilled_subtrees_are_not_final():
    rng = random.Random(2)
    keys = [bytes(rng.choice(b"abc") for _ in range(9)) for _ in range(2000)]
    out = list(exact._through_tries((((1, 2), k, [0, i, b""]) for i, k in enumerate(keys)), exact._lesser, 400))
    final = [k for k, _, done in out if done]
    assert len(final) == len(set(final)) and not set(final) & {k for k, _, done in out if not done}
    assert {k for k, _, _ in out} == set(keys)
