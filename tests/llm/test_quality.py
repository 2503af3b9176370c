"""Gradients against differences, and accuracy on rows held out."""

import zlib

import numpy as np
import pyarrow as pa

from rastertable.llm import quality
from rastertable.llm.queries import QUERIES


def test_encode():
    x, first = quality.encode(pa.array(["", "a b b", None, "w " * 200 + "w"], pa.string()))
    assert first.tolist() == [0, 1, 2, 3, 7] and not x[0].any() and not x[2].any()
    assert np.isclose(x[1, quality.PAIRS], 1 / 3) and x[6, quality.PAIRS] == 1
    alone, _ = quality.encode(pa.array(["w " * 200 + "w"]))
    assert np.array_equal(alone, x[3:])


def test_gradients():
    rng = np.random.default_rng(1)
    x, first, y = rng.standard_normal((9, quality.WIDTH)), np.array([0, 2, 3, 9]), np.array([1, 0, 1])
    w = {k: rng.standard_normal(s) * 0.3 for k, s in {"W": (quality.WIDTH, 4), "b": 4, "V": (4, 3), "U": (4, 3), "w": 3, "c": 4, "d": ()}.items()}
    model = quality.Model(0.5, 0, 1, w)
    loss = lambda: -np.mean(np.log(np.where(y, p := model.forward(x, first)["p"], 1 - p)))
    f = model.forward(x, first)
    assert np.allclose(np.add.reduceat(f["a"], first[:-1]), 1)
    grads = quality._gradients(w, x, f, (f["p"] - y) / 3)
    for k in w:
        flat = np.atleast_1d(w[k]).ravel()
        i, old = rng.integers(flat.size), w[k]
        step = np.zeros(flat.size)
        step[i] = 1e-5
        w[k] = old + step.reshape(np.shape(old))
        up = loss()
        w[k] = old - step.reshape(np.shape(old))
        down = loss()
        w[k] = old
        assert np.isclose((up - down) / 2e-5, np.atleast_1d(grads[k]).ravel()[i], atol=1e-6)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "a b", 6), (2, "", 7), (2, "", 7)], "doc_id long, text string, score int")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.learn(df, none)
    assert model.weights is None and [r.score for r in quality.score(df, model).collect()] == [0.5] * 4
    assert quality.score(df.limit(0), model).count() == 0
    assert quality.accepted(df, model).columns == df.columns and quality.accepted(df, model).count() == 4


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op10_quality"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good = [p for y, p in held if y == 1]
    bad = [p for y, p in held if y == 0]
    print(len(good), np.mean(good), len(bad), np.mean(bad))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def test_scores_equal_plain_loop(spark):
    """One passage after the other in plain loops, over texts of many passages, one of them very long."""
    rng = np.random.default_rng(5)
    words = ["Word", "a", "of,", "x1", "END.", "ü", "(b)"]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 64, 65, 700, 40_000)]
    x, first = quality.encode(pa.array(texts))
    w = {k: rng.standard_normal(s) * 0.3 for k, s in {"W": (quality.WIDTH, 4), "b": 4, "V": (4, 3), "U": (4, 3), "w": 3, "c": 4, "d": ()}.items()}
    model = quality.Model(0.5, x.mean(0), x.std(0) + 1e-3, w)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.score(df, model).collect():
        codes, weights = [], []
        for k in range(first[r.doc_id], first[r.doc_id + 1]):
            h = np.tanh(((x[k] - model.mean) / model.scale) @ w["W"] + w["b"])
            gate = [1 / (1 + np.exp(-sum(h[i] * w["U"][i, j] for i in range(4)))) for j in range(3)]
            weights.append(np.exp(sum(np.tanh(sum(h[i] * w["V"][i, j] for i in range(4))) * gate[j] * w["w"][j] for j in range(3))))
            codes.append(h)
        z = sum(a * h for a, h in zip(weights, codes, strict=True)) / sum(weights)
        assert np.isclose(r.score, 1 / (1 + np.exp(-(z @ w["c"] + w["d"]))), rtol=1e-4)
