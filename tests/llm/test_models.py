"""Operators 8 and 9 and the pipeline: exact search, toxicity, stages."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import SF_DIR
from tests.llm.fixtures import by_id, documents, prose
from tests.llm.test_native import base_spans
from tests.llm.test_similar import brute_classes
from tracelab.llm import raking, topk, toxicity


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").selectExpr("*", "'own' AS score", "'own' AS v")


def brute_top(data, every, k):
    good = {}
    for i, v, _ in data:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault(i, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64))
    out = []
    for q in sorted(good):
        if q % every == 0:
            best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "leaf"), [(4096, 128), (40, 4)])
def test_top_k_equals_brute_force(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk.KdTree.__init__, "__defaults__", (leaf,))
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(size=6).astype(np.float32).tolist(), 1) for i in range(300)]
    data += [(1000 + i, data[7][1], 1) for i in range(60)]  # ties
    data += [(5, None, 1), (2000, [float("nan")] * 6, 1), (2010, [None] * 6, 1), (2020, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (2030, [1.0, 2.0], 1), (2040, [], 1)]
    data = [d for d in data if d[0] != 5 or d[1] is None]
    assert by_id(topk.top_k(vectors(spark, data), every=10), "query_id", "rank", "vec_id", "score") == brute_top(data, 10, 5)


def test_top_k_of_few_and_of_large_vectors(spark):
    assert topk.top_k(vectors(spark, [])).count() == 0
    assert topk.top_k(vectors(spark, [(0, [1.0], 1)])).count() == 0
    assert by_id(topk.top_k(vectors(spark, [(0, [1.0], 1), (3, [2.0], 1)])), "query_id", "rank", "vec_id", "score") == [(0, 1, 3, 131072)]
    large = [(i, [3e4 * (i + 1), -1e5, 2e5], 1) for i in range(60)]
    assert by_id(topk.top_k(vectors(spark, large)), "query_id", "rank", "vec_id", "score") == brute_top(large, 50, 5)
    same = [(1, [1.0], 1), (1, [1.0], 1), (50, [2.0], 1), (50, [2.0], 1)]
    assert by_id(topk.top_k(vectors(spark, same)), "query_id", "rank", "vec_id") == [(50, 1, 1), (50, 2, 1)]


def toxic_rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = prose(rng, rng.randint(5, 120)).split()
        bad = i % 6 == 0
        for _ in range(3 if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["idiot", "Trash!", "stupid", "moron,"])
        out.append((i, " ".join(words), "en", f"src{i % 3}", 0, int(bad)))
    return out


def test_toxicity_on_held_out_documents(spark):
    train, held = toxic_rows(300, 1), toxic_rows(200, 2)
    labels = spark.createDataFrame([(r[0], r[5], None) for r in train] + [(None, 1, 0), (9999, None, 1)], "doc_id long, toxic int, quality int")
    chain = toxicity.train(documents(spark, [r[:5] for r in train]), labels)
    assert chain.names == ["person", "contempt", "toxic"] and len(chain.models[2].chained) == 2
    odd = [(5000, None, "", "", 0), (5001, "", "", "", 0), (5002, "1 2 ... !", "", "", 0), (5003, "idiot " * 30_000, "", "", 0)]
    docs = documents(spark, [r[:5] for r in held] + odd)
    out = toxicity.scored(docs, chain)
    assert out.columns == [*docs.columns, "p_person", "p_contempt", "p_toxic", "is_toxic"]
    got = dict(by_id(out, "doc_id", "is_toxic"))
    assert np.mean([got[r[0]] == bool(r[5]) for r in held]) > 0.97
    assert not any(got[i] for i in (5000, 5001, 5002)) and got[5003]
    assert toxicity.scored(documents(spark, []), chain).count() == 0


def test_toxicity_without_labels_or_of_one_kind(spark):
    docs = documents(spark, [r[:5] for r in toxic_rows(30, 3)])
    for rows_ in ([], [(i, 0) for i in range(30)]):
        chain = toxicity.train(docs, spark.createDataFrame(rows_, "doc_id long, toxic int"))
        assert toxicity.scored(docs, chain).where("is_toxic").count() == (0 if rows_ else toxicity.scored(docs, chain).where("p_toxic >= 0.5").count())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "toxicity", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "byte-level BPE encoding and decoding",
    ]
    clean = corpus_pipeline.durable(stages["toxicity"](spark, docs, SF_DIR))
    assert clean.columns == docs.columns
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").where("toxic = 1").collect()}
    gone = set(texts) - {r["doc_id"] for r in clean.collect()}
    assert gone and len(gone - bad) <= 0.05 * len(texts)
    one = corpus_pipeline.durable(stages["n-gram Jaccard join"](spark, clean, SF_DIR))
    rows_ = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert {r["doc_id"] for r in one.collect()} == {i for i, _, c, _ in brute_classes(rows_) if i == c}
    masked = corpus_pipeline.durable(stages["secret scans"](spark, one, SF_DIR))
    assert masked.columns == docs.columns and masked.count() == one.count()
    assert not any(base_spans(r["text"]) for r in masked.collect())
    mixed = corpus_pipeline.durable(stages["mixing sources to target weights"](spark, masked, SF_DIR))
    want = by_id(raking.sampled(masked, corpus_pipeline.SHARE).where("kept"), "doc_id")
    assert by_id(mixed, "doc_id") == want and mixed.columns == docs.columns
    last = stages["byte-level BPE encoding and decoding"](spark, mixed, SF_DIR)
    decoded = [(r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in mixed.collect()]
    assert by_id(last, "doc_id", "decoded_sha256") == sorted(decoded)


def test_pipeline_on_odd_rows(spark):
    data = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (None, "token = abcdefgh", "en", "s", 9)]
    docs = documents(spark, data, extra=False)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.durable(stage(spark, docs, SF_DIR))
        if name.startswith("n-gram"):
            assert sorted(map(str, (r["doc_id"] for r in docs.collect()))) == ["1", "2", "3", "None"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == docs.count()


def test_pipeline_keeps_columns_with_its_own_names(spark):
    names = ("_hash", "_cuts", "_doc", "_content", "_source", "_lang", "_topic", "_probability", "is_odd", "named")
    data = [(1, "token = abcdefgh " + "word " * 9, "en", "s", 60), (1, "another text of the same id", "en", "s", 27), (None, "", None, None, 0), (4, "the last of these texts", "en", "t", 23)]
    docs = documents(spark, data, extra=False)
    for name in names:
        docs = docs.selectExpr("*", f"'own {name}' AS {name}")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = corpus_pipeline.durable(stage(spark, docs, SF_DIR))
        assert all(r[n] == f"own {n}" for r in docs.collect() for n in names)
        assert name.startswith("mixing") or docs.count() == 4
    empty = documents(spark, [], extra=False)
    for _, stage in corpus_pipeline.STAGES[1:]:
        empty = corpus_pipeline.durable(stage(spark, empty, SF_DIR))
    assert empty.count() == 0
