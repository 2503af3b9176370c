"""Apportionment and mixing against plain versions, and against DuckDB."""

import heapq
import random
from collections import defaultdict

import pytest
from oracle_check import compare, connect

from rastertable.llm import mixing
from rastertable.llm.queries import ORACLES, QUERIES


def seats_of(weights, seats):
    heap = [(-w, k, 0) for k, w in enumerate(weights) if w > 0]
    heapq.heapify(heap)
    out = [0] * len(weights)
    for _ in range(seats if heap else 0):
        _, k, n = heapq.heappop(heap)
        out[k] += 1
        heapq.heappush(heap, (-weights[k] / (2 * n + 3), k, n + 1))
    return out


def test_apportion(spark):
    rnd, rows, want = random.Random(5), [], {}
    for g in range(12):
        weights = [rnd.choice([0, 1, rnd.randint(1, 50), rnd.randint(1, 10_000)]) for _ in range(rnd.randint(1, 40))]
        seats = rnd.choice([0, 1, 7, rnd.randint(0, 3000)])
        for k, (w, s) in enumerate(zip(weights, seats_of(weights, seats), strict=True)):
            rows.append((g, k, float(w), seats, float(sum(weights)), len(weights)))
            want[g, k] = s
    df = spark.createDataFrame(rows, "g int, k int, w double, seats long, total double, n long")
    got = {(r.g, r.k): r.own for r in mixing.apportion(df, ["g"], ["k"], "w", "seats", "total", "n", "own").collect()}
    assert got == want


def targets_of(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixed(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join("w" * rnd.randint(0, 60)), rnd.choice(["a"] * 10 + ["b", "Z", "é", None]), i) for i in range(3000)]
    rows += [(None, None, "a", 0), (3, rows[3][1], rows[3][2], 0), (5000, "", "only empty", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = targets_of(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert taken[s] == pytest.approx(want[s], rel=0.01, abs=40)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(df.repartition(5)).collect()))
    assert mixing.mixed(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf), QUERIES["op3_mixing"], ORACLES["op3_mixing"], sf).startswith("ok")


def test_resampled_keeps_columns_of_any_name(spark):
    rows = [(i, "w " * i, "a", i, -i, "x") for i in range(40)] + [(None, None, None, 0, 0, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, own_id long, copies long, copy_ string").withColumn("own_id_", mixing.F.lit(5))
    got = mixing.resampled(df)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} <= {tuple(r) for r in df.collect()} and got.count() > 20
