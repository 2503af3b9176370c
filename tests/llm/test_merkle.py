"""Manifests against a plain recursive version."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from oracle_check import compare, connect

from rastertable.llm import merkle
from rastertable.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Top, and for each node the runs on its way with its place in them."""
    ways = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(k, min(k + 16, len(nodes))) for k in range(0, len(nodes), 16)]
        for run in runs:
            for j, k in enumerate(run):
                for i in under[k]:
                    ways[i].append(([nodes[x] for x in run], j))
        under = [[i for k in run for i in under[k]] for run in runs]
        nodes = [h(*(nodes[k] for k in run)) for run in runs]
    return nodes[0], ways


def plain(rows):
    of = defaultdict(list)
    for r in rows:
        of[r[1]].append(r)
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    tops, ways = {}, {}
    for s in names:
        of[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        tops[s], ways[s] = tree([leaf(r) for r in of[s]])
    root, over = tree([tops[s] for s in names])
    out = []
    for s, last in zip(names, over, strict=True):
        for r, way in zip(of[s], ways[s], strict=True):
            way = way + last
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = r[4]
            if bad and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            top = leaf([*r[:4], text])
            for run, j in way:
                top = h(*run[:j], top, *run[j + 1:])
            out.append((r[0], leaf(r), tops[s], root, h(*(x for run, j in way for x in run[:j] + run[j + 1:])), top, top == root))
    return out


def rows_of(rnd, n):
    ids = [rnd.choice([rnd.randint(-300, 300), rnd.randint(-2**63, 2**63 - 1), 2**63 - 1, -2**63, 63, -1, None]) for _ in range(n)]
    sources = ["a", "a", "a", "a", "", "=", "ä", "b", "~", "\U0001f600", "￿", None]
    rows = [(i, rnd.choice(sources), rnd.choice(["en", None, ""]), rnd.choice([None, 5]), rnd.choice(["Text", None, "", "ÄB c", "lower"])) for i in ids]
    return rows + rows[: n // 5]


@pytest.mark.parametrize("n", [1, 2, 17, 700])
def test_manifest(spark, n):
    rows = rows_of(random.Random(n), n)
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("tree", "place", "node", "size", "slots", "word"):  # further columns with names that are used inside
        df = df.selectExpr("*", f"1 AS {c}")
    got = merkle.manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == Counter(plain(rows))


def test_long_text_and_many_sources(spark):
    rows = [(i, f"s{i}", "en", 1, "A") for i in range(300)] + [(1000 + i, "one", "en", 1, "Long text " * 200_000 * (i == 7)) for i in range(300)]
    assert Counter(map(tuple, merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect())) == Counter(plain(rows))


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), QUERIES["op11_merkle"], ORACLES["op11_merkle"], sf).startswith("ok")
