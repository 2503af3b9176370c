"""Repair of conversations against a search over all edits, states and audits."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from rastertable.llm import conversations as C
from rastertable.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def cheapest(rows):
    """Cost, audit and repaired turns, by trying everything from every state."""
    @cache
    def best(i, state, inserted):
        ways = [(0, "", ())] if i == len(rows) and state in "0a" else []
        if inserted < 4:
            to = "a" if state == "u" else "u"
            cost, audit, turns = best(i, to, inserted + 1)
            ways.append((cost + 3, "I" + audit, ({"u": "user:", "a": "assistant:"}[to], *turns)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, audit, turns = best(i + 1, state, 0)
            ways.append((cost + 4, "D" + audit, turns))
            if fault not in ("blank", "duplicate"):
                broken = 3 * (fault == "truncated")
                if role[:1] in {"0": "su", "s": "u", "u": "a", "a": "u"}[state] and role[:1]:
                    cost, audit, turns = best(i + 1, role[:1], 0)
                    ways.append((cost + broken, "K" + audit, (f"{role}:{text}", *turns)))
                to = "a" if state == "u" else "u"
                cost, audit, turns = best(i + 1, to, 0)
                ways.append((cost + 3 + broken, "R" + audit, ({"u": "user:", "a": "assistant:"}[to] + text, *turns)))
        return min(ways, default=(10**9, "", ()), key=lambda w: w[:2])

    for i in range(len(rows), 0, -20):  # shallow recursion
        for s in "0sua":
            best(i, s, 0)
    return best(0, "0", 0)


def plain(rows):
    of = defaultdict(list)
    for r in damage(rows):
        of[r[0]].append(r)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(of[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            end = text.rstrip(SPACE)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        count = Counter(faults)
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, kept = cheapest([(r[2], r[3], f) for r, f in zip(own, faults, strict=True)])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"],
                    illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def random_rows(rnd, convs, most):
    texts = ["Yes.", "No!", "and then", "why? ", " \t", "", "…", None, "e.g. this\n", "x."] + [f"Turn {i}." for i in range(most)]
    rows = []
    for conv in convs:
        for turn in range(rnd.randint(1, most)):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User", "sys"])
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 3, None, -turn]), role, rnd.choice(texts)))
    return rows


def check(spark, rows):
    got = C.repaired(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS conv", "2 AS at", "3 AS kind"))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain(rows))


def test_short(spark):
    check(spark, random_rows(random.Random(1), [*range(400), None, -5, 2**62], 12))


def test_long(spark, monkeypatch):
    """Conversations of many chunks, also those whose chunks never forget what is behind them."""
    monkeypatch.setattr(C, "CHUNK", 8)
    rnd = random.Random(2)
    rows = random_rows(rnd, [1, 2], 400)
    rows += [(3, i, "user", f"Again {i}.") for i in range(401)]  # parity of the place decides
    rows += [(4, i, "tool", f"Other {i}.") for i in range(300)]
    rows += [(5, i, "user", "The same.") for i in range(500)]  # all but one are deleted
    rows += [(6, i, ("user", "assistant")[i % 2], f"Fine {i}.") for i in range(500)]
    rows += [(7, 0, "user", "Same turn.")] * 60
    rnd.shuffle(rows)
    check(spark, rows)


def test_edges(spark):
    gone = [i for i in range(2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    check(spark, [(i, 0, "user", "lost") for i in gone] + [(None, None, None, None), (1, 3, "user", "Long. " * 300_000), (1, 4, "assistant", "word " * 200_000 + "\x1f")])
    assert C.repaired(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_kernels(seed):
    """Chunks started from all vectors at once end where one run over all rows does."""
    rnd = np.random.default_rng(seed)
    kinds = [list(map(int, rnd.integers(0, len(C.KINDS), n))) for n in (0, 1, 5, 40)]
    tables = C.back_tables(pa.array(kinds, pa.list_(pa.int8())))
    vectors, _ = C._cost_vectors()
    for own, table in zip(kinds, tables, strict=True):
        for i, start in enumerate(vectors):
            costs = start
            for k in reversed(own):
                costs = C._before(C.KINDS[k], costs)
            assert vectors[table[i]] == tuple(c - min(costs) for c in costs)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, QUERIES["op12_conversations"](spark, sf).collect())) == Counter(plain(rows))
