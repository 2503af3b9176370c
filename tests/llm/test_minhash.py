"""Components and near-duplicate classes against plain versions."""

import random
import re
from itertools import combinations

import pytest
from oracle_check import compare, connect

from rastertable.llm import minhash
from rastertable.llm.graph import components
from rastertable.llm.queries import ORACLES, QUERIES


def roots(nodes, edges):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in nodes}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 200)] + [(rnd.randrange(400, 700), rnd.randrange(400, 700)) for _ in range(250)]
    rnd.shuffle(edges)
    want = roots({x for e in edges for x in e}, edges)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {(r.node, r.component) for r in components(df).collect()} == {(x, r) for x, r in want.items() if x != r}
    assert components(df.limit(0)).count() == 0


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def plain(rows, n):
    own = [(d, shingle_set(t, n)) for d, t, *_ in rows if d is not None]
    links = [(a, b) for (a, x), (b, y) in combinations(own, 2) if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    root = roots({d for d, _ in own}, links)
    return sorted(((d, len(shingle_set(t, n)), None if d is None else root[d], d is None or root[d] == d) for d, t, *_ in rows), key=str)


@pytest.mark.parametrize("n", [4, 5])
def test_linked(spark, n):
    rnd = random.Random(n)
    word = lambda: "".join(rnd.choices("abcdefgh", k=3))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rnd.choice([5, 30, 150]))]
        for _ in range(rnd.choice([1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(copy)
    base = [word() for _ in range(120)]
    for k in range(60):  # like the base, but not like each other
        copy = list(base)
        copy[2 * k], copy[(2 * k + 61) % 120], copy[(2 * k + 31) % 120] = word(), word(), word()
        texts.append(copy)
    texts += [base] + [passage + [word() for _ in range(40)] for _ in range(40)]
    rnd.shuffle(texts)
    rows = [(7 * i, rnd.choice(["\n", " "]).join(t).upper() if i % 3 else "  ".join(t), i, 0) for i, t in enumerate(texts)]
    rows += [(5001, None, 0, 0), (5002, "", 0, 0), (5003, " \t", 0, 0), (5004, "one two", 0, 0), (5005, "ONE\x0btwo", 0, 0), (None, rows[0][1], 0, 0), (rows[0][0], rows[0][1], 0, 0),
             (rows[1][0], "another text of the same id here", 0, 0), (9000, "another text of the same id here", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, component long")
    got = sorted((tuple(r) for r in minhash.linked(df, minhash.Rule(words=n)).collect()), key=str)
    assert got == plain(rows, n)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.linked(df).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf), QUERIES["op9_minhash"], ORACLES["op9_minhash"], sf).startswith("ok")


def test_distinct_keeps_columns_of_any_name(spark):
    text = "one two three four five six seven eight"
    df = spark.createDataFrame([(1, text, 7, 8), (2, text, 9, 10), (3, None, 1, 2), (None, text, 3, 4)], "doc_id long, text string, own_id long, own_id_ long")
    assert sorted(map(tuple, minhash.distinct(df).collect()), key=str) == sorted([(1, text, 7, 8), (3, None, 1, 2), (None, text, 3, 4)], key=str)


def test_several_centres(spark):
    """Heavily edited copies around more than one centre, and copies that share additions: links equal those of all pairs."""
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(10**6)}"
    base = [word() for _ in range(150)]
    other = base[:110] + [word() for _ in range(40)]
    texts = [base, other]
    for k in range(300):
        copy = list(rnd.choice([base, base, other]))
        for _ in range(rnd.choice([1, 2, 5, 8, 12, 20])):
            copy[rnd.randrange(150)] = word()
        if k % 3 == 0:
            at = rnd.randrange(120)
            copy[at:at] = other[120:140]
        texts.append(copy)
    rows = [(i, " ".join(t), 0, 0) for i, t in enumerate(texts)]
    got = sorted((tuple(r) for r in minhash.linked(spark.createDataFrame(rows, "doc_id long, text string, n long, component long"), minhash.Rule(words=4)).collect()), key=str)
    assert got == plain(rows, 4)
