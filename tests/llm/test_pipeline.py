"""The pipeline's stages, each against a plain version on its own input."""

from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from test_minhash import plain
from test_secrets import plain as plain_secrets

from rastertable.llm import bpe, mixing, quality

SF = "/root/testdata/sf0.01"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, inputs[-1], SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        inputs.append(spark.createDataFrame(out.collect(), docs.schema))
    raw, good, distinct, clean, mixed = (rows(df) for df in inputs)
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert sorted(good) == sorted(r for r in raw if scores[r[0]] >= 0.3)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r[0] for r in good}
    assert np.mean([d in kept for d, y in labels.items() if y == 1]) > 0.97 and np.mean([d in kept for d, y in labels.items() if y == 0]) < 0.15
    keep = {d for d, _, _, k in plain(good, 5) if k}
    assert sorted(distinct) == sorted(r for r in good if r[0] in keep)
    before = {r[0]: r for r in distinct}
    assert len(clean) == len(distinct)
    for d, text, *rest in clean:
        found = plain_secrets(before[d][1])
        assert (text == before[d][1]) == (not found) and rest[-1] == len(text) and not (found and text.count("[SECRET]") == 0)
        assert not [s for s in plain_secrets(text) if s[0] in ("access", "hex")]
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mixed(inputs[3]).collect()}
    copies = Counter(r[0] for r in mixed)
    assert set(mixed) <= set(clean) and all(abs(copies[d] - t / max(1, s)) < 1 for d, (t, s) in taken.items())
    assert abs(sum(copies[d] * s for d, (_, s) in taken.items()) / sum(t for t, _ in taken.values()) - 1) < 0.1


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(out) > 500
    same = 0
    for r in out:
        ids = list(memoryview(bytes(r.ids)).cast("I"))
        assert len(ids) == r.n_tokens
        text = e.decode(ids)
        assert text == texts[r.doc_id] or "[SECRET]" in text
        same += text == texts[r.doc_id]
        assert ids == e.encode_ordinary(text)
    assert same > 0.8 * len(out)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", "a", None, "x"), (2, "", None, None, 0, "x"), (None, "token=abcdefgh and more words", "en", "a", 3, "x"), (3, "w " * 100_000, "en", "a", 3, "x"),
         (3, "w " * 100_000, "en", "a", 3, "x")], "doc_id long, text string, lang string, source string, n_chars long, size string")
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert name == "bpe" or out.columns == docs.columns
            out.count()
