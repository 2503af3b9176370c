"""The walk against its definition; pairs of neighbours; likeness of near and far texts."""

import hashlib
import random

import numpy as np
from test_minhash import roots

from rastertable.llm import fingerprints as fp
from rastertable.llm.queries import QUERIES


def plain_walk(text):
    """(step, position) of each step of the walk."""
    moves = np.random.default_rng(20240501).integers(0, 2, (fp.CLASSES, fp.PERIOD))
    i, j, out = 0, 0, []
    while i < len(text):
        out.append(i)
        c = (ord(text[i]) * 0x9E3779B1 % 2**32) >> 24
        i += moves[c][j % fp.PERIOD]
        j += 1
    return out


def test_walk():
    rnd = random.Random(1)
    texts = ["".join(rnd.choices("abcdé ", k=n)) for n in [1, 2, 5, 33, 700, 5000]] + ["".join(rnd.choices("xyz", k=300)) for _ in range(100)]
    classes = [((fp.code_points(t) * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8) for t in texts]
    both = fp._walk(classes), [fp._walk([c])[0] for c in classes]
    for t, (at, steps), (at1, steps1) in zip(texts, *both, strict=True):
        want = plain_walk(t)
        assert steps == steps1 == len(want) and at.tolist() == at1.tolist() == [want.index(i) for i in range(len(t))]
    assert [x.tolist() for x in fp.fingerprints(texts)] == [fp.fingerprints([t])[0].tolist() for t in texts]


def test_likeness():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8)))
    near, far, half = [], [], []
    for _ in range(60):
        a, b = [word() for _ in range(400)], [word() for _ in range(400)]
        c = a[:100] + [word()] + a[101:300] + a[301:]
        x, y, z, w = fp.fingerprints([" ".join(a), " ".join(b), " ".join(c), fp.edited(" ".join(a), " ".join(b))])
        near.append(fp.likeness(x, z))
        far.append(fp.likeness(x, y))
        half.append(fp.likeness(x, w))
    assert np.mean(near) > 0.6 and np.mean(far) < 0.1 and 0.35 < np.mean(half) < 0.65
    e = np.zeros(0, np.uint8)
    assert fp.likeness(e, e) == 1 and fp.likeness(x, e) == 0 and fp.likeness(x, x) == 1
    assert np.array_equal(fp.samples_of(fp.text_of(x)), x)


def want(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in ordered]
    after = texts[1:] + texts[:1]
    out = []
    for (d, *_), t, n in zip(ordered, texts, after, strict=True):
        x, y, z = fp.fingerprints([t, e := fp.edited(t, n), n])
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.text_of(x), fp.text_of(y), fp.likeness(x, y), fp.likeness(x, z)))
    return sorted(out, key=str)


def test_next(spark):
    rnd = random.Random(3)
    rows = [(i * 7 - 50, "".join(rnd.choices("abé漢𝒳 ", k=rnd.randint(0, 40))), 0, "k") for i in range(200)]
    rows += [(None, "no id", 0, "k"), (rows[3][0], "again", 0, "k"), (rows[3][0], None, 0, "k"), (rows[-1][0], "x" * 3000, 0, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int, key string")
    assert sorted(map(tuple, fp.compare_with_next(df).collect()), key=str) == want(rows)
    assert fp.compare_with_next(df.limit(0)).count() == 0
    assert sorted(map(tuple, fp.compare_with_next(df.limit(1)).collect()), key=str) == want([tuple(df.first())])
    assert fp.fingerprint(df).count() == len(rows)


def test_near(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8)))
    rows = []
    for i in range(40):
        a = [word() for _ in range(500)]
        rows += [(3 * i, " ".join(a)), (3 * i + 1, " ".join(a)), (3 * i + 2, " ".join(a[:-3] + [word()] * 3))]
    got = {(r.doc_id, r.leader) for r in fp.near(fp.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert {(3 * i + 1, 3 * i) for i in range(40)} <= got and len({(3 * i + 2, 3 * i) for i in range(40)} & got) > 35
    assert all(a // 3 == b // 3 for a, b in got)


def tied(spark, prints, **more):
    """Classes by links of near(), and by all pairs."""
    rows = sorted(prints.items())
    links = [(a, b) for k, (a, x) in enumerate(rows) for b, y in rows[:k] if fp.likeness(x, y) >= 0.8]
    got = fp.near(spark.createDataFrame([(d, fp.text_of(x)) for d, x in rows], "doc_id long, fingerprint string"), **more).collect()
    assert all(r.leader < r.doc_id and r.likeness == fp.likeness(prints[r.doc_id], prints[r.leader]) >= 0.8 for r in got)
    return roots(prints, [(r.doc_id, r.leader) for r in got]), roots(prints, links)


def test_near_under_a_leader(spark):
    rng = np.random.default_rng(5)
    base, prints = rng.integers(0, 16, 160).astype(np.uint8), {}
    for k in range(150):  # half like the first one and each other, with a near copy each
        own = np.where(rng.random(160) < 0.5, base, rng.integers(0, 16, 160)).astype(np.uint8)
        prints[1 + 2 * k], prints[2 + 2 * k] = own, own.copy()
        prints[2 + 2 * k][rng.choice(160, 4, replace=False)] ^= 1
    # like the first one where bands look, so it leads all their buckets, but not elsewhere
    unseen = np.ones(160, bool)
    for pick in fp._picks(12, 6):
        unseen[[*(96 + pick), *(64 + pick)]] = False
    for k in range(40):
        own = np.where(unseen, rng.integers(0, 16, 160), base).astype(np.uint8)
        prints[500 + 2 * k], prints[501 + 2 * k] = own, own.copy()
        prints[501 + 2 * k][:4] ^= 1
    for k in range(60):  # a large group of near copies
        prints[1000 + k] = base.copy()
        prints[1000 + k][rng.choice(160, 2, replace=False)] ^= 3
    prints[0] = base
    got, want = tied(spark, prints, block=16)
    assert got == want and sum(r != d for d, r in want.items()) > 200
    assert all(want[501 + 2 * k] > 0 for k in range(40))


def test_near_of_short_texts(spark):
    rng = np.random.default_rng(6)
    prints = {}
    for k in range(300):
        n = int(rng.integers(1, 78))
        x = rng.integers(0, 16, 90).astype(np.uint8)
        y = x[:n + int(rng.integers(0, n // 6 + 1))].copy()
        y[rng.choice(n, n // 8, replace=False)] ^= 5
        prints[3 * k], prints[3 * k + 1] = x[:n], y
    got, want = tied(spark, prints)
    assert got == want and sum(r != d for d, r in want.items()) > 100


def test_near_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {d: x for d, x in zip(texts, fp.fingerprints(list(texts.values())), strict=True) if len(x)}
    got = {r.doc_id: r.class_id for r in QUERIES["op7_near"](spark, sf).collect()}
    want = tied(spark, prints)[1]
    assert set(got) == set(texts) and all(want[d] == want[r] for d, r in got.items() if d in prints)
    assert sum(got[d] != r for d, r in want.items()) <= len(texts) // 100


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, QUERIES["op7_fingerprints"](spark, sf).collect()), key=str) == want(rows)
