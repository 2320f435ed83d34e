"""Each stage of the pipeline, and the chain, against brute force."""

import re

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from spanwright.llm import pii, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark, odd):
    more = spark.read.parquet(f"{SF}/documents.parquet")
    clash = [c for c in odd.columns if c not in more.columns]
    return more.selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "CAST(n_chars AS BIGINT) AS n_chars", *(f"'clash' AS {c}" for c in clash)).unionByName(odd)


@pytest.fixture(scope="module")
def chain(spark, docs, tmp_path_factory):
    """What each stage gets, and what the last one gives."""
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("chain") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def keys(df):
    return sorted(str((r.doc_id, r.text)) for r in df.select("doc_id", "text").collect())


def test_stages_are_the_five_of_the_readme():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
    assert all(f.__doc__ for _, f in corpus_pipeline.STAGES) and corpus_pipeline.ORACLE_SQL is None


def test_toxic_documents_go(spark, docs, chain):
    from test_toxicity import slow_score

    model = toxicity.fit_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = sorted(str((r.doc_id, r.text)) for r in docs.select("doc_id", "text").collect() if slow_score(model, r.text) < 0.5)
    assert keys(chain[1]) == want and chain[1].dtypes == docs.dtypes


def test_one_of_equal_texts_stays(chain):
    groups = {}
    for r in chain[1].select("doc_id", "text").collect():
        rank = (-len(r.text or ""), 1 << 70 if r.doc_id is None else r.doc_id)
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        groups[key] = min(groups.get(key, rank), rank)
    got = [(-len(r.text or ""), 1 << 70 if r.doc_id is None else r.doc_id) for r in chain[2].select("doc_id", "text").collect()]
    assert sorted(got) == sorted(groups.values()) and chain[2].dtypes == chain[1].dtypes


def test_one_of_near_copies_stays(chain):
    """Of the texts that pairs with a Jaccard similarity of 0.8 connect, over all pairs, the smallest doc_id stays."""
    rows = chain[2].select("doc_id", "text").collect()
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        rank = (r.doc_id is None, r.doc_id or 0)
        least[find(i)] = min(least.get(find(i), rank), rank)
    assert sorted(str(r.doc_id) for r in chain[3].collect()) == sorted(str(None if last else d) for last, d in least.values())
    assert chain[3].dtypes == chain[2].dtypes and chain[3].count() < chain[2].count()


def test_entities_give_way(chain):
    any_ = regex.compile("|".join(f"(?:{x})" for x in pii.PATTERNS.values()))
    before = {r.doc_id: r.text for r in chain[3].collect() if r.doc_id is not None}
    after = {r.doc_id: r.text for r in chain[4].collect() if r.doc_id is not None}
    assert before.keys() == after.keys() and chain[4].dtypes == chain[3].dtypes
    for k, text in before.items():
        found = [m[0] for m in any_.finditer(text or "")]
        assert (after[k] == text) == (not found)
        assert not any(m in after[k] for m in found if len(m) > 8)
    assert sum(before[k] != after[k] for k in before) > 3


def test_pieces_hold_every_token(chain):
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = chain[5].toPandas()
    want = sorted(str((r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in chain[4].collect() if r.doc_id is not None)
    known = rows[rows.doc_id.notna()].sort_values(["doc_id", "piece"])
    got = [str((int(d), np.frombuffer(b"".join(g.ids), "<u4").tolist())) for d, g in known.groupby("doc_id")]
    assert sorted(got) == want
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.r_[0, g.length.cumsum()[:-1]].tolist() and g.length.sum() <= 4096


def test_empty_tables_pass_all_stages(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
