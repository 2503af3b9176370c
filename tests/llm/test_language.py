"""Language identification: gradients, a plain scorer, held-out accuracy, rejection, edge cases."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rastertable.llm import language as L
from rastertable.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string"


def plain_buckets(text):
    folded = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in (" " + text.lower() + " ").encode())
    out = []
    for size in L.SIZES:
        for i in range(len(folded) - size + 1):
            piece = folded[i:i + size]
            if (32 not in piece[1:-1] if size > 2 else piece != b"  "):
                code = size
                for b in piece:
                    code = ((code ^ b) * 0x01000193) % 2**32
                code ^= code >> 15
                out.append(((code * 0x9E3779B1) % 2**32) >> (32 - L.BUCKETS_LOG2))
    return out


def random_model(k=3):
    rng = np.random.default_rng(1)
    return L.Model([f"l{i}" for i in range(k)], rng.standard_normal((L.BUCKETS, k)).astype(np.float32), rng.standard_normal(k), 1.5, 0.5)


TEXTS = ["", " ", "a", "Ä", "A b", "Hello, wörld! 123 x", "12 % …", "日本語 テキスト", None, "No 1\n\ttabs", "x" * 50, "\u00c9t\u00c9 I"]


@pytest.mark.parametrize("block", [L.BLOCK, 7])
def test_scores_equal_plain_loop(monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    model = random_model()
    names, scores = model.predict(pa.array(TEXTS))
    for text, name, score in zip(TEXTS, names, scores, strict=True):
        if text is None or not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0)
            continue
        found = plain_buckets(text)
        logits = [sum(float(model.scores[b, k]) for b in found) / len(found) + model.bias[k] for k in range(3)]
        e = [np.exp((x - max(logits)) / 1.5) for x in logits]
        assert name == f"l{int(np.argmax(e))}" and score == pytest.approx(max(e) / sum(e), rel=1e-6)


def test_gradients():
    rng = np.random.default_rng(0)
    table, weights, bias = rng.standard_normal((40, 5)), rng.standard_normal((5, 3)), rng.standard_normal(3)
    bags, y = [rng.integers(0, 40, n) for n in (3, 1, 7)], np.array([0, 2, 1])
    _, dw, db, rows, flat = L.gradients(table, weights, bias, bags, y)
    dt = np.zeros_like(table)
    np.add.at(dt, flat, rows)
    for own, grad in ((table, dt), (weights, dw), (bias, db)):
        for at in np.ndindex(own.shape):
            held = own[at]
            own[at] = held + 1e-6
            up = L.gradients(table, weights, bias, bags, y)[0]
            own[at] = held - 1e-6
            down = L.gradients(table, weights, bias, bags, y)[0]
            own[at] = held
            assert grad[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_bound_of_rejection():
    model = random_model(2)
    rng = np.random.default_rng(3)
    bags = [rng.integers(0, L.BUCKETS, 4) for _ in range(400)]
    y = rng.integers(0, 2, 400)
    found = L.calibrated(model, bags, y)
    p = L.softmax((np.array([model.scores[b].mean(0) for b in bags]) + model.bias) / found.temperature)
    above = p.max(1) >= found.least
    assert not above.any() or (p.argmax(1) != y)[above].sum() <= max(1, L.ERRORS * above.sum())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_held_out_accuracy(spark, sf):
    path = f"/root/testdata/{sf}"
    got = QUERIES["op13_language"](spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    right = [r.lang == r.lang_pred for r in got if r.held_out]
    assert np.mean(right) >= 0.98
    sure = [r.lang == r.lang_pred for r in got if r.held_out and r.accepted]
    assert np.mean(sure) >= 0.98 and len(sure) >= 0.9 * len(right)


def test_rows(spark):
    rows = [(i, f"{w} {w}a", lang, "s") for i, (w, lang) in enumerate([("the", "en"), ("der", "de")] * 30)]
    odd = [(None, "der", "de", None), (0, "the the", "en", "s"), (70, None, "en", "s"), (71, "", None, ""), (72, "12", "de", "x"), (73, "the " * 300_000, None, "x")]
    df = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 AS lang_pred", "2 AS score", "3 AS n")
    model = L.learn(df)
    assert model.languages == ["de", "en"]
    got = [(r.doc_id, r.lang_pred) for r in L.identify(df, model).collect()]
    assert sorted(got, key=str) == sorted([(r[0], "und" if r[1] in (None, "", "12") else "en" if "the" in r[1] else "de") for r in rows + odd], key=str)
    none = L.learn(df.filter("lang IS NULL"))
    assert {(r.lang_pred, r.score, r.accepted) for r in L.identify(df, none).collect()} == {("und", 0.0, False)}
    one = L.learn(df.filter(F.col("lang") == "de"))
    assert {r.lang_pred for r in L.identify(df, one).collect()} == {"und", "de"}
    assert L.identify(df.limit(0), model).collect() == [] and L.learn(df.limit(0)).languages == []
