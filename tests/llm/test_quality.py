import os
import zlib

import numpy as np
import pytest

from placework.llm import quality as Q


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    x, passages, y = rng.normal(size=(7, Q.FEATURES)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    m = {"w": rng.normal(size=(Q.FEATURES, 4)), "b": rng.normal(size=4), "v": rng.normal(size=(4, 3)), "u": rng.normal(size=(4, 3)), "a": rng.normal(size=3), "c": rng.normal(size=4), "d": rng.normal(size=1)}

    def loss():
        p = Q._forward(m, x, passages)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = Q._gradients(m, x, passages, y)
    for name, values in m.items():
        at = tuple(rng.integers(0, n) for n in values.shape)
        kept = values[at]
        values[at] = kept + 1e-6
        high = loss()
        values[at] = kept - 1e-6
        low = loss()
        values[at] = kept
        assert g[name][at] == pytest.approx((high - low) / 2e-6, rel=1e-3, abs=1e-7)


def test_features_of_a_batch_are_those_of_each_text():
    texts = ["One two. THREE!!", "", "a b " * 100, "é | é | é", " \n"]
    features, passages = Q.passage_features(texts)
    assert passages.tolist() == [1, 1, 4, 1, 1]
    for text, own in zip(texts, np.split(features, np.cumsum(passages)[:-1])):
        assert np.allclose(own, Q.passage_features([text])[0])


def test_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (8, None, 0), (None, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    rows = Q.quality_scores(hard, labels).collect()
    assert len(rows) == hard.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert {r.doc_id: r.held_out for r in rows} == {k: zlib.crc32(str(k).encode()) % 4 == 2 if k else False for k in (1, 2, 3, 4, 5, None, 7, 8, 9)}
    assert Q.quality_scores(empty, labels).collect() == []
    assert Q.keep_quality(hard, labels).columns == hard.columns
    assert {r.score for r in Q.quality_scores(hard, labels.limit(0)).collect()} == {0.5}


def test_accuracy_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98


def plain_score(text, model):
    """The score of one text, byte by byte and passage by passage."""
    import math

    space = b"\t\n\v\f\r "
    passages, words, inside = [{"shares": [0] * Q._SHARES, "words": []}], 0, False
    for byte in text.encode() + b"\n":
        if byte in space:
            inside = False
        elif not inside:
            inside = True
            if words and words % Q.PASSAGE_WORDS == 0:
                passages.append({"shares": [0] * Q._SHARES, "words": []})
            words += 1
            passages[-1]["words"].append(bytearray())
        if inside:
            passages[-1]["words"][-1].append(byte)
        passages[-1]["shares"][Q._CLASS[byte]] += 1
    encoded = []
    m = model.weights
    for passage in passages:
        own, shares = [bytes(w) for w in passage["words"]], passage["shares"]
        n = max(len(own), 1)
        x = [s / max(sum(shares), 1) for s in shares]
        x += [
            math.log1p(len(own)), sum(shares[2:]) / n / 10, len(set(own)) / n, sum(a == b for a, b in zip(own, own[1:])) / n,
            sum(len(w) <= 4 for w in own) / n, sum(len(w) > 20 for w in own) / n,
        ]
        x = [(v - a) / b for v, a, b in zip(x, model.mean, model.scale)]
        h = [math.tanh(sum(v * w for v, w in zip(x, column)) + b) for column, b in zip(m["w"].T, m["b"])]
        gate = [
            math.tanh(sum(a * b for a, b in zip(h, v))) / (1 + math.exp(-sum(a * b for a, b in zip(h, u)))) for v, u in zip(m["v"].T, m["u"].T)
        ]
        encoded.append((math.exp(sum(a * b for a, b in zip(gate, m["a"]))), h))
    total = sum(e for e, _ in encoded)
    z = [sum(e / total * h[k] for e, h in encoded) for k in range(len(encoded[0][1]))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, m["c"])) - m["d"][0]))


def test_scores_are_those_of_a_plain_computation(spark, hard):
    rng = np.random.default_rng(7)
    texts = ["good words in a row. " * 30, "BAD!!! $$$ %%% ", "one", " \v lead", "é " * 200, "same same same 1 2 3 |", ""] + [r.text or "" for r in hard.collect()]
    bags = [Q.passage_features([t])[0] for t in texts]
    model = Q.train_attention(bags, rng.integers(0, 2, len(bags)).tolist())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in Q.score_quality(docs, model).collect()}
    assert got == pytest.approx({k: plain_score(t, model) for k, t in enumerate(texts)}, abs=1e-9)
