"""Encoding against tiktoken, decoding against the text."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rastertable.llm import bpe
from rastertable.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def ids(text):
    return list(memoryview(bpe.codec(PATH, PATTERN).encode([text])[0]).cast("I"))


def test_cases(reference):
    long = "".join(random.Random(3).choice("abcdeéß") for _ in range(20_000))
    for text in ["", " ", "  a  b ", "it's I'LL", "\x1c\x1d a b　c", "naïve Ünï 漢字 ٣٤ 𝒳𝟙", "<|endoftext|>", "a" * 5000, "ab" * 3000, long, long * 5, "é𝒳" * 300, "\r\n\t x\n\n"]:
        assert ids(text) == reference.encode_ordinary(text), text[:40]
        assert bpe.codec(PATH, PATTERN).decode(bpe.codec(PATH, PATTERN).encode([text])[0]) == text.encode()


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.characters(exclude_categories=["Cs", "Cn", "Co"]), max_size=60))
def test_any_text(reference, text):
    e = reference
    assert ids(text) == e.encode_ordinary(text)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (1, "", "z"), (1, "", "z")], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in rows) == [b"", b"", b"", b"a b"]
    assert bpe.encode(df.limit(0), PATH, PATTERN).count() == 0


def test_query(spark, reference):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op8_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aeinorstéh ", min_size=1, max_size=120), min_size=1, max_size=8))
def test_many_at_once(reference, texts):
    c = bpe.codec(PATH, PATTERN)
    c.known = {}
    assert [list(memoryview(x).cast("I")) for x in c.encode(texts)] == [reference.encode_ordinary(t) for t in texts]
