"""The automaton and the scan against plain searches."""

import random
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rastertable.llm import licences
from rastertable.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def places(text):
    w = words(text)
    return sorted((i, label) for phrase, label in licences.PHRASES.items() for p in [phrase.split()]
                  for i in range(len(w)) if w[i:i + len(p)] == p)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.integers(0, 4), max_size=20))
def test_statistics(sequences, text):
    a = licences.SuffixAutomaton(sequences)
    for i, (length, state) in enumerate(a.statistics(text)):
        runs = [n for n in range(i + 2) if n == 0 or any(s[j:j + n] == text[i + 1 - n:i + 1] for s in sequences for j in range(len(s)))]
        assert length == max(runs)
        if length:
            run = text[i + 1 - length:i + 1]
            assert a.ends[state] == [(k, j + length) for k, s in enumerate(sequences) for j in range(len(s) - length + 1) if s[j:j + length] == run]


PARTS = st.sampled_from(["CC BY", "cc", "by", "General  Public License", "general public", "all rights", "Reserved", "ALL RIGHTS RESERVED", ".", "-", "É", "x1"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=9).map(" ".join), max_size=5))
def test_places(texts):
    n, found, _ = licences.find(pa.array(texts, pa.string()), licences.Library())
    assert n.tolist() == [len(words(t)) for t in texts]
    assert [[(p["start"], p["label"]) for p in row] for row in found] == [places(t) for t in texts]


def test_spans():
    mit = licences.TEMPLATES["mit"].split()
    changed = mit[:10] + ["oddly"] + mit[10:20] + mit[23:]
    text = "x " * 30 + " ".join(changed) + " y" * 9
    _, _, spans = licences.find(pa.array([text, " ".join(mit[:20]), " ".join(mit * 2), "".join(random.Random(1).choices("the of to and ", k=999))]), licences.Library())
    assert [(s["label"], s["start"], s["end"]) for s in spans[0]] == [("mit", 30, 30 + len(changed))] and spans[0][0]["share"] > 0.9
    assert spans[1] == [] and spans[3] == []
    assert [(s["start"], s["share"]) for s in spans[2]] == [(0, 1.0), (len(mit), 1.0)]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (None, "CC BY 4.0", 1), (1, "", 2), (1, "", 2)], "doc_id long, text string, n_words int")
    rows = sorted(((r.doc_id or -1, r.n_words, len(r.places)) for r in licences.scan(df).collect()))
    assert rows == [(-1, 4, 1), (1, 0, 0), (1, 0, 0), (1, 0, 0)]
    assert licences.scan(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_licences"](spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_base for r in rows) > 0
    for r in rows:
        p = places(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (len(words(texts[r.doc_id])), len(p))
        assert (r.first_word, r.last_word) == ((p[0][0], p[-1][0]) if p else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in p})) and set(r.labels.split(",")) >= set(r.base_labels.split(","))
        assert 0 <= r.score <= 1
