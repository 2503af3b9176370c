"""Scans against plain regular expressions; queries against what matches must hold."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from rastertable.llm import secrets
from rastertable.llm.queries import QUERIES

ALL = secrets.BASE + secrets.MORE


def plain(text, rules=ALL):
    out = []
    for k, r in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text, r.flags) if len(m.group(r.group)) >= r.least]
    return [(rules[k].kind, a, b) for a, k, b in sorted(out)]


def test_queries():
    q = [secrets.trigram_query(r.pattern, r.flags) for r in secrets.BASE]
    assert secrets.trigrams(q[0]) >= {b"tok", b"api", b"pas", b"key"}
    assert secrets.trigrams(q[1]) == {b"aki", b"kia"}
    assert q[2] is True
    assert secrets.trigrams(secrets.trigram_query("a(bcd|efg)*h")) == set()
    assert secrets.trigrams(secrets.trigram_query("(ab)?cdx?e")) == {b"abc", b"bcd", b"cde", b"cdx", b"dxe"}


PARTS = st.sampled_from(["password", "TOKEN", "api_key", "apikey", "=", ": ", "'", '"', "abc", "Zx9+/", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef" * 3, "0f",
                         " ", "é", "ghp_", "x" * 36, "-----BEGIN RSA PRIVATE KEY-----", "http://u:p@h", "eyJabcdefgh.", "\n", "ſecret", "toKen"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=8).map("".join), max_size=6))
def test_find(texts):
    found = secrets.find(pa.array(texts, pa.string()), ALL)
    assert [[(s["kind"], s["start"], s["end"]) for s in row] for row in found] == [plain(t) for t in texts]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "token=abcdefgh", "y"), (1, "", "z"), (1, "", "z"), (2, "é" * 9 + "AKIA" + "A" * 16, "")],
                               "doc_id long, text string, spans string")
    rows = {(r.doc_id, tuple(map(tuple, r.spans))) for r in secrets.scan(df).collect()}
    assert rows == {(1, ()), (None, (("assign", 0, 14),)), (2, (("access", 9, 29),))}
    assert secrets.scan(df.limit(0)).count() == 0
    texts = [r.text for r in secrets.redact(df).collect()]
    assert texts == [None, "[SECRET]", "", "", "é" * 9 + "[SECRET]"]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_secrets"](spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_assign for r in rows) > 0
    for r in rows:
        base = plain(texts[r.doc_id], secrets.BASE)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in base).encode()).hexdigest()
        assert r.spans == ",".join("%s:%d:%d" % s for s in plain(texts[r.doc_id]))
