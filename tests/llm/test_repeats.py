"""Suffix order, segments and removal against plain versions."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rastertable.llm import induced, repeats
from rastertable.llm.queries import QUERIES


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 20))
def test_suffix_order(t, most):
    t = np.array(t, np.int64)
    order = induced.suffix_order(t, 10_000, most)
    assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def plain(rows, n=50):
    """Of each row: doc_id, bytes, removed, spans, digest."""
    first: dict[bytes, int] = {}
    key = lambda d: repeats.LAST if d is None else d
    for d, t, *_ in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - n + 1):
            first[raw[i:i + n]] = min(key(d), first.get(raw[i:i + n], repeats.LAST))
    out = []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - n + 1):
            if first[raw[i:i + n]] < key(d):
                gone[i:i + n] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        out.append((d, len(raw), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, sum(s.b - s.a for s in r.spans), len(r.spans), r.kept_sha256) for r in df.collect()), key=str)


def test_without_repeats(spark):
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choices("abcdé \n", k=n))
    passages = [text(n) for n in (49, 50, 51, 80, 300, 2000)]
    rows = []
    for i in range(120):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else text(rnd.randint(0, 200)) for _ in range(rnd.randint(0, 5))]
        rows.append((rnd.randrange(10_000) * 2, "".join(parts), 1, "x"))
    rows += [(1, "a" * 400, 1, "x"), (3, "b" + "a" * 70 + "c", 1, "x"), (5, "xyz" * 300, 1, "x"), (7, "yzx" * 20, 1, "x"), (9, None, 1, "x"), (11, "", 1, "x"), (13, "\0" * 60, 1, "x"),
             (15, "q" + "\0" * 55, 1, "x"), (None, rows[0][1] + passages[4], 1, "x"), (None, passages[5], 1, "x"), (17, passages[4], 1, "x"), (17, passages[4], 1, "x"), (17, passages[5][:999], 1, "x"),
             (2001, rows[5][1], 1, "x"), (20_001, passages[5], 1, "x"), (20_003, passages[5], 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc int, uid string").repartition(7)
    assert got(repeats.without_repeats(df)) == plain(rows)
    assert repeats.without_repeats(df.limit(0)).count() == 0


def test_hot_keys(spark):
    rnd = random.Random(10)
    text = lambda n: "".join(rnd.choices("abcdefgh", k=n))
    passage, common = text(300), text(40)
    rows = [(i, text(rnd.randint(0, 60)) + passage + rnd.choice(["", common]) + text(rnd.randint(0, 60))) for i in range(300)]
    rows += [(1000 + i, "\0" * (60 + 7 * i) + text(3)) for i in range(40)] + [(2000 + i, "xy" * (100 + i)) for i in range(20)] + [(3000, "\0" * 140_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(repeats.without_repeats(df, shard_bytes=2000)) == plain(rows)
    cut = spark.createDataFrame([(k, k, t.encode(), k, 9) for k, t in enumerate([passage, passage[5:], "q" + passage, "z" * 99])], "key long, digest long, content binary, low long, high long")
    out = {r.key: [(x.at, x.n, x.doc) for x in r.runs] for r in repeats._split(cut, 50).collect()}
    assert out == dict(enumerate(repeats.earliest([passage.encode(), passage[5:].encode(), b"q" + passage.encode(), b"z" * 99], np.arange(4), 50)))


def test_many_copies_and_keys_meet_without_texts(spark, monkeypatch):
    """Beyond the bounds of broadcasts no text or content is spread over salts, and the result is the same."""
    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choices("abcdefgh", k=n))
    passage, common = text(300), text(60)
    rows = [(i, text(rnd.randint(0, 60)) + passage[rnd.randint(0, 20):] + rnd.choice(["", common]) + text(rnd.randint(0, 60))) for i in range(60)]
    rows += [(100 + i, rows[i % 9][1]) for i in range(30)] + [(5, rows[3][1]), (None, rows[4][1]), (None, common), (70, rows[0][1]), (70, text(80) + common), (-4, rows[8][1])]
    seen, join = [], repeats.join_small
    for name in ("FEW_KEYS", "FEW_COPIES"):
        monkeypatch.setattr(repeats, name, 0, raising=False)
    monkeypatch.setattr(repeats, "join_small", lambda big, small, keys, bound=0, **k: seen.append(big.columns) or join(big, small, keys, 0, **k))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for shard in (repeats.SHARD_BYTES, 2000):
        assert got(repeats.without_repeats(df, shard_bytes=shard)) == plain(rows)
    assert seen and not {"text", "content"} & {c for columns in seen for c in columns}


def test_negative_ids(spark):
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choices("abcdefgh", k=n))
    passages = [text(n) for n in (60, 200, 900)]
    rows = [(k - 30, text(rnd.randint(0, 90)) + rnd.choice(passages) + text(rnd.randint(0, 90))) for k in range(60)] + [(-(1 << 63), passages[0]), (-1, passages[2])]
    # partitions of their own, so documents meet in buckets and not within a slice
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    assert got(repeats.without_repeats(df)) == plain(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = sorted((tuple(r) for r in QUERIES["op4_repeats"](spark, sf).collect()), key=str)
    assert out == plain(rows) and sum(r[2] for r in out) > 0
