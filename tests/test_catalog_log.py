"""The catalog as a log against a dictionary, with two writers, compaction and pages by key."""

import random

import pytest

from rastertable.operators.catalog import CatalogError
from rastertable.sources.catalog_log import CatalogLog

KEYS = ["sensor", "date"]


def frame(spark, rows):
    return spark.createDataFrame([(*k, p) for k, p in rows], "sensor string, date string, path string")


def meta(spark, rows):
    return spark.createDataFrame([(*k, v) for k, v in rows], "sensor string, date string, mean double")


def content(catalog):
    return ({(r.sensor, r.date): r.path for r in catalog.datasets.collect()}, {(r.sensor, r.date): r["mean"] for r in catalog.metadata.collect()})


def test_commits_equal_a_dictionary(spark, tmp_path):
    rnd = random.Random(1)
    log = CatalogLog.create(spark, str(tmp_path / "c"), KEYS, compact_after=4, file_rows=5)
    data, stats, seen = {}, {}, {}
    for step in range(9):
        some = {(f"s{rnd.randrange(4)}", f"d{rnd.randrange(8)}"): f"p{step}" for _ in range(6)}
        given = {k: float(step) for k in list(some)[:3]}
        if step % 4 == 3:
            gone = rnd.sample(sorted(data), 3)
            version = log.delete(spark.createDataFrame(gone, "sensor string, date string"))
            for k in gone:
                data.pop(k), stats.pop(k, None)
        elif step % 4 == 2:
            given = {k: 100.0 + step for k in rnd.sample(sorted(data), 2)}
            version = log.add_metadata(meta(spark, given.items()))
            stats |= given
        else:
            version = log.upsert(frame(spark, some.items()), meta(spark, given.items()) if step % 2 else None)
            data |= some
            for k in some:
                stats.pop(k, None)
            stats |= given if step % 2 else {}
        seen[version] = (dict(data), dict(stats))
        assert content(log.load()) == (data, stats)
    for version, then in seen.items():  # older versions stay readable
        assert content(log.load(version)) == then
    assert len(log.record()["deltas"]) < 4 and log.record()["base"]


def test_refuses(spark, tmp_path):
    log = CatalogLog.create(spark, str(tmp_path / "c"), KEYS)
    with pytest.raises(CatalogError, match="already"):
        CatalogLog.create(spark, str(tmp_path / "c"), KEYS)
    with pytest.raises(CatalogError, match="same keys"):
        log.upsert(frame(spark, [(("a", "b"), "1"), (("a", "b"), "2")]))
    with pytest.raises(CatalogError, match="same keys"):
        log.add_metadata(meta(spark, [(("a", "b"), 1.0), (("a", "b"), 2.0)]))
    with pytest.raises(CatalogError, match="no dataset"):
        log.delete(spark.createDataFrame([("a", "b")], "sensor string, date string"))
    with pytest.raises(FileNotFoundError):
        CatalogLog(spark, str(tmp_path / "none")).load()
    assert log.versions() == [1]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    """Both see version 1; one record is made, and the other change comes on top of it, whatever the clock says."""
    one = CatalogLog.create(spark, str(tmp_path / "c"), KEYS)
    two = CatalogLog(spark, one.root)
    stale = two.record()
    assert one.upsert(frame(spark, [(("a", "1"), "one")])) == 2
    assert not two._claim({**stale, "version": 2, "deltas": ["lost"]})
    true, first = two.record, iter([stale, stale])
    monkeypatch.setattr(two, "record", lambda version=None: next(first, None) or true(version))
    assert two.upsert(frame(spark, [(("a", "2"), "two")])) == 3
    assert content(one.load())[0] == {("a", "1"): "one", ("a", "2"): "two"}
    old, first = one.record(), iter([one.record(), one.record(), one.record()])
    assert old["version"] == 3
    one.upsert(frame(spark, [(("a", "3"), "three")]))
    monkeypatch.setattr(two, "record", lambda version=None: next(first))
    with pytest.raises(CatalogError, match="another writer"):
        two.delete(spark.createDataFrame([("a", "1")], "sensor string, date string"))
    assert set(content(one.load())[0]) == {("a", "1"), ("a", "2"), ("a", "3")}


def test_commit_cost_does_not_grow(spark, tmp_path):
    log = CatalogLog.create(spark, str(tmp_path / "c"), KEYS)
    log.upsert(frame(spark, [(("s", f"{i:05d}"), "x" * 200) for i in range(20_000)]))
    log.compact()
    log.upsert(frame(spark, [(("s", "00007"), "new")]))
    delta = log.record()["deltas"][-1]
    assert spark.read.parquet(f"{delta}/datasets").count() == 1
    assert sum(p.stat().st_size for p in __import__("pathlib").Path(delta).rglob("*.parquet")) < 20_000
    assert log.load().datasets.where("path = 'new'").count() == 1 and log.load().datasets.count() == 20_000


def test_pages_by_key(spark, tmp_path):
    rnd = random.Random(3)
    log = CatalogLog.create(spark, str(tmp_path / "c"), KEYS, file_rows=10)
    data = {(f"s{rnd.randrange(5)}", f"d{i:03d}"): f"p{i}" for i in range(150)}
    log.upsert(frame(spark, data.items()))
    assert [tuple(r)[:2] for r in log.page_after(None, 7).collect()] == sorted(data)[:7]  # no base yet
    log.compact()
    gone = sorted(data)[20:60]
    log.delete(spark.createDataFrame(gone, "sensor string, date string"))
    log.upsert(frame(spark, [(("s0", "a"), "first"), (("zz", "z"), "last"), (sorted(data)[80], "changed")]))
    data = {k: v for k, v in data.items() if k not in gone} | {("s0", "a"): "first", ("zz", "z"): "last", sorted(data)[80]: "changed"}
    pages, cursor = [], None
    while page := log.page_after(cursor, 13).collect():
        pages += [tuple(r) for r in page]
        cursor = tuple(page[-1])[:2]
    assert pages == [(*k, data[k]) for k in sorted(data)]
    some = log.page_after(("s2", ""), 5, {"sensor": ["s2", "s4"]}).collect()
    assert [tuple(r)[:2] for r in some] == [k for k in sorted(data) if k[0] in ("s2", "s4")][:5]
    read = log.page_after(sorted(data)[90], 5)
    assert sum(log.record()["base"] in f for f in set(read.inputFiles())) <= 2


def test_tagged_steps_count_once(spark, tmp_path):
    log = CatalogLog.create(spark, str(tmp_path / "c"), KEYS)
    rows, none = frame(spark, [(("a", "1"), "x"), (("a", "2"), "y")]), spark.createDataFrame([], "sensor string, date string")
    assert log.apply(rows, meta(spark, [(("a", "1"), 1.0)]), none, ("s", 4)) == 2
    assert log.apply(frame(spark, [(("a", "1"), "again")]), meta(spark, []), none, ("s", 4)) == 2
    assert log.apply(frame(spark, []), meta(spark, []), spark.createDataFrame([("a", "2"), ("no", "no")], "sensor string, date string"), ("s", 5)) == 3
    assert content(log.load()) == ({("a", "1"): "x"}, {("a", "1"): 1.0})
    assert log.apply(frame(spark, [(("b", "1"), "z")]), meta(spark, []), none, ("other", 0)) == 4
