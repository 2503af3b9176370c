"""Archives written and read back."""

import gzip
import hashlib
from pathlib import Path

import pytest
from oracle_check import compare, connect

from rastertable.llm import warc
from rastertable.llm.queries import ORACLES, QUERIES
from rastertable.llm.tables import new_folder


def local(folder):
    return Path(folder.removeprefix("file:"))


def test_round_trip(spark):
    same, odd = "<p>" + "x" * 200, "\r\n\r\nWARC/1.1 é 漢\n"
    rows = [(4, "u4", same, 1), (2, "u2", same, 1), (9, None, same, 1), (None, "n", same, 1), (5, "a\nb", odd, 1), (6, "u", odd, 1), (7, "", None, 1), (8, "e", "", 1),
            (2, "u2", same, 1), (10, "long", "é" * 300_000, 1)]
    rows += [(100 + i, f"u{i}", f"page {i} " * 30, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    folders = ["file:" + new_folder(spark, "warc").removeprefix("file:") for _ in range(2)]
    manifests = [warc.write(df.repartition(n), f, roll_bytes=2000) for n, f in zip((3, 5), folders, strict=True)]
    files = spark.read.parquet(manifests[0]).collect()
    assert sum(f.records for f in files) == len(rows) and len(files) > 4
    for f in files:
        raw = (local(folders[0]) / f.file).read_bytes()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (f.bytes, f.sha256) and gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
    assert not list(local(folders[0]).glob(".part*"))
    assert {f.sha256 for f in files} == {f.sha256 for f in spark.read.parquet(manifests[1]).collect()}
    got = warc.read(spark, manifests[0]).collect()
    text = {(p, u if u != "a\nb" else "a%0Ab"): (h or "").encode() for p, u, h, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        want = text[r.page_id, r.url]
        assert (r.payload_bytes, r.payload_digest) == (len(want), hashlib.sha256(want).hexdigest())
        revisit = want == same.encode() and r.page_id != 2
        assert (r.record_type, r.refers_to) == (("revisit", 2) if revisit else ("response", None))
        assert r.payload == (None if revisit else want)


def test_damage_and_empty(spark):
    folder = "file:" + new_folder(spark, "warc").removeprefix("file:")
    df = spark.createDataFrame([(1, "u", "h" * 500)], "page_id long, url string, html string")
    manifest = warc.write(df, folder)
    name = spark.read.parquet(manifest).first().file
    raw = (local(folder) / name).read_bytes()
    (local(folder) / name).write_bytes(raw[:-20])
    with pytest.raises(Exception, match="ends within a record|invalid|Error"):
        warc.read(spark, manifest).collect()
    assert warc.read(spark, warc.write(df.limit(0), f"{folder}-empty")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf), QUERIES["op6_warc"], ORACLES["op6_warc"], sf).startswith("ok")
