"""Graph search and embedding classes against brute force."""

import numpy as np
from test_minhash import roots

from rastertable.llm import embeddings, flatgraph
from rastertable.llm.queries import QUERIES


def cloud(rng, n, d=24, groups=40):
    base = rng.standard_normal((groups, d))
    x = np.concatenate([rng.standard_normal((n // 2, d)), base[rng.integers(groups, size=n - n // 2)] + 0.25 * rng.standard_normal((n - n // 2, d))])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_graph():
    rng = np.random.default_rng(1)
    x = cloud(rng, 900)
    edges = flatgraph.build(x)
    assert ((edges >= -1) & (edges < len(x))).all() and (edges != np.arange(len(x))[:, None]).all()
    ids, sims = flatgraph.greedy(x, edges, x, np.array([flatgraph.medoid(x)]), 24)
    assert (ids[:, 0] == np.arange(len(x))).mean() > 0.97
    q, node = flatgraph.in_range(x, edges, x, np.arange(len(x)), np.array([flatgraph.medoid(x)]), 0.9)
    s = x @ x.T
    np.fill_diagonal(s, 0)
    want = set(zip(*np.nonzero(s >= 0.9), strict=True))
    got = set(zip(q.tolist(), node.tolist(), strict=True))
    assert got <= want and len(got) > 0.97 * len(want) > 500


def want(rows, least=0.9):
    good = [(i, np.array(v, float) / max(map(abs, v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {}
    edges = []
    for k, (i, v) in enumerate(good):
        for j, w in good[:k]:
            if len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                edges.append((i, j))
    root = roots({i for i, _ in rows if i is not None}, edges)
    for i, j in edges:
        links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
    return {(i, links.get(i, 0), None if i is None else root[i], i is None or root[i] == i) for i, _ in rows}


def test_linked(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(5000)[:500], cloud(rng, 500), strict=True)]
    rows += [(10_000 + k, rows[7][1]) for k in range(60)]
    rows += [(20_000, None), (20_001, []), (20_002, [0.0] * 24), (20_003, [1.0, None] * 12), (20_004, [float("nan")] + [1.0] * 23), (20_005, [float("inf")] * 24), (None, rows[7][1]),
             (20_006, [1.0, 2.0]), (20_007, [2.0, 4.0]), (20_008, [1e200] * 24), (20_009, [1e-200] * 24)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = {tuple(r) for r in embeddings.linked(df, embeddings.Rule(cluster=60, slice=64)).collect()}
    exact = want(rows)
    assert len(got) == len(exact) and len(got & exact) > 0.95 * len(exact)
    assert {r for r in got if (r[0] or 0) >= 10_000} == {r for r in exact if (r[0] or 0) >= 10_000}
    assert embeddings.linked(df.limit(0)).count() == 0
    assert {r.kept for r in embeddings.linked(df.filter("vec_id = 20002")).collect()} == {True}


def test_dense_shard(spark):
    """One group that no cut can part without losing links is searched slice by slice; a loose table is cut."""
    rng = np.random.default_rng(3)
    dense = rng.standard_normal(16) + 0.05 * rng.standard_normal((300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([dense, rng.standard_normal((200, 16))]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    rule = embeddings.Rule(cluster=20, slice=100, sample=16)  # two centroids
    assert {tuple(r) for r in embeddings.linked(df, rule).collect()} == want(rows)
    assert len([r for r in want(rows) if r[1] >= 299]) == 300
    one = embeddings.prepared(df).withColumn("copies", embeddings.F.lit(1).cast("long"))
    whole = embeddings.sharded(one, np.ones((1, 16), np.float32), rule)
    sizes = lambda rows: sorted(r["count"] for r in rows.groupBy("shard").count().collect())
    assert sizes(whole) == [500] and sizes(embeddings.cut(whole.filter("vec_id < 300"), rule)) == [300]
    loose = embeddings.cut(whole.filter("vec_id >= 300"), rule).collect()
    assert {r.vec_id for r in loose} == set(range(300, 500)) and len({r.shard for r in loose}) > 1
    shards = {}
    for r in loose:
        shards.setdefault(r.vec_id, set()).add(r.shard)
    assert all(r.shards == sorted(shards[r.vec_id]) for r in loose)


def test_audit(spark):
    """Links that are missed show up, and more overlap that does not find them is an error."""
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(cloud(rng, 120))]
    one = embeddings.prepared(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).withColumn("copies", embeddings.F.lit(1).cast("long"))
    told = spark.createDataFrame([r[:2] for r in want(rows)], "vec_id long, links long")
    assert embeddings.audit(one, told, embeddings.Rule()) == 1.0
    assert embeddings.audit(one, told.filter("vec_id % 2 = 0"), embeddings.Rule()) < 0.9
    assert embeddings.audit(one.limit(0), told, embeddings.Rule()) == 1.0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {tuple(r) for r in QUERIES["op5_embeddings"](spark, sf).collect()}
    assert got == want(rows)
