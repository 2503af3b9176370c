import pytest
from pyspark.sql import functions as F

from rastertable.operators import catalog as cat
from rastertable.operators import ingest as I
from rastertable.operators.catalog import Catalog, CatalogError
from rastertable.sources import paths as P
from rastertable.sources.store import CatalogStore

KEYS = ["key1", "akey", "key2"]
ROWS = [("val11", "x", "val12", "a"), ("val21", "x", "val22", "a"), ("val21", "x", "val23", "a"), ("val21", "x", "val24", "a")]


@pytest.fixture(scope="module")
def catalog(spark):
    rows = spark.createDataFrame(ROWS, "key1 STRING, akey STRING, key2 STRING, path STRING")
    return Catalog.create(spark, KEYS, {"key2": "key2"}).insert(rows)


def _keys(df):
    return [tuple(r)[:3] for r in df.collect()]


@pytest.mark.parametrize("where,n", [
    ({"key1": "val21"}, 3), ({"key1": "val21", "key2": "val23"}, 1), ({"key1": ["val21"]}, 3),
    ({"key2": ["val23", "val24"], "akey": "x"}, 2), (["val21"], 3), (None, 4), ({"key1": []}, 0)])
def test_search(catalog, where, n):
    assert len(_keys(catalog.search(where))) == n


def test_search_unknown_key(catalog):
    with pytest.raises(CatalogError):
        catalog.search({"nope": "x"})


def test_paging(catalog):
    assert _keys(catalog.search(page=1, limit=2)) == [("val21", "x", "val23"), ("val21", "x", "val24")]
    assert _keys(catalog.search(page=1000, limit=2)) == []
    assert len(_keys(catalog.search(page=5))) == 4  # without a limit the page is ignored
    with pytest.raises(ValueError):
        catalog.search(page=-1, limit=2)


def test_keys(catalog):
    assert [tuple(r) for r in catalog.list_keys().collect()] == [("key1", None), ("akey", None), ("key2", "key2")]


@pytest.mark.parametrize("keys,descriptions", [(["a b"], None), (["limit"], None), (["a", "a"], None), (["a"], {"b": "x"}), ([], None)])
def test_bad_keys(spark, keys, descriptions):
    with pytest.raises(CatalogError):
        Catalog.create(spark, keys, descriptions)


def test_delete(spark, catalog):
    gone = spark.createDataFrame([("val11", "x", "val12")], "key1 STRING, akey STRING, key2 STRING")
    assert len(_keys(catalog.delete(gone).datasets)) == 3
    absent = spark.createDataFrame([("no", "x", "val12")], "key1 STRING, akey STRING, key2 STRING")
    with pytest.raises(CatalogError):
        catalog.delete(absent)


def test_upsert_replaces_and_drops_stale_metadata(spark, catalog):
    meta = spark.createDataFrame([(*r[:3], float(i)) for i, r in enumerate(ROWS)], "key1 STRING, akey STRING, key2 STRING, min DOUBLE")
    full = meta.select(*KEYS, *[(F.col("min") if c == "min" else F.lit(None)).cast(t).alias(c) for c, t in cat.METADATA_COLUMNS.items()])
    known = catalog.add_metadata(full)
    assert known.missing_metadata().isEmpty()
    new = spark.createDataFrame([("val11", "x", "val12", "old", 1), ("val11", "x", "val12", "new", 2)],
                                "key1 STRING, akey STRING, key2 STRING, path STRING, n INT")
    changed = known.insert(new, order="n")
    assert [r["path"] for r in changed.search({"key1": "val11"}).collect()] == ["new"]
    assert _keys(changed.missing_metadata()) == [("val11", "x", "val12")]
    assert known.metadata_of(("val21", "x", "val23"), ["min"]).first()["min"] == 2.0
    with pytest.raises(KeyError):
        known.metadata_of(("val21", "x", "val23"), ["nope"])
    with pytest.raises(CatalogError):
        known.metadata_of(("val21", "x"))
    requests = cat.request_table(spark, KEYS, [ROWS[2][:3], ROWS[0][:3], ROWS[2][:3]])
    assert [r["min"] for r in known.metadata_batch(requests, ["min"]).collect()] == [2.0, 0.0, 2.0]
    assert cat.request_table(spark, KEYS, [ROWS[0][:3]] * 101).count() == 101
    with pytest.raises(CatalogError):
        known.metadata_of(("no", "no", "no"))
    missing = cat.request_table(spark, KEYS, [("no", "no", "no")])
    with pytest.raises(Exception, match="no metadata for"):
        known.metadata_batch(missing, ["min"]).collect()


def test_last_key(catalog):
    moved = catalog.with_last_key("key1")
    assert moved.keys == ["akey", "key2", "key1"]
    assert [r["key_name"] for r in moved.list_keys().collect()] == ["akey", "key2", "key1"]


def test_store(spark, catalog, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "cat"))
    assert not store.exists()
    saved = store.save(catalog)
    assert saved.keys == KEYS and saved.datasets.count() == 4
    gone = spark.createDataFrame([("val11", "x", "val12")], "key1 STRING, akey STRING, key2 STRING")
    store.save(store.load().delete(gone))
    assert CatalogStore(spark, str(tmp_path / "cat")).load().datasets.count() == 3


def test_duplicate_keys_need_an_order(spark, catalog):
    twice = spark.createDataFrame([("x", "y", "z", "p", 1), ("x", "y", "z", "q", 2)], "key1 STRING, akey STRING, key2 STRING, path STRING, n INT")
    with pytest.raises(CatalogError):
        catalog.insert(twice.drop("n"))
    assert catalog.insert(twice, order="n").search({"key1": "x"}).first()["path"] == "q"


def test_dead_writer_and_two_writers(spark, catalog, tmp_path, monkeypatch):
    root = tmp_path / "cat"
    store = CatalogStore(spark, str(root))
    store.save(catalog)
    (root / "commits" / "v00000002").mkdir()  # a writer that died before its record
    (root / "commits" / "v00000002-dead" / "_temporary").mkdir(parents=True)
    assert store.save(store.load()).datasets.count() == 4
    late = CatalogStore(spark, str(root))
    before = late._latest()
    gone = spark.createDataFrame([("val11", "x", "val12")], "key1 STRING, akey STRING, key2 STRING")
    store.save(store.load().delete(gone))
    monkeypatch.setattr(late, "_latest", lambda: before)  # it has read the catalog before the other one wrote
    with pytest.raises(CatalogError):
        late.save(catalog)
    assert store.load().datasets.count() == 3


def test_version_must_match(spark, catalog):
    old = Catalog(catalog.key_names, catalog.datasets, catalog.metadata, spark.createDataFrame([("0.7.5",)], "version STRING"))
    with pytest.raises(CatalogError):
        old.check_version()


def test_upgrade(spark):
    keys = spark.createDataFrame([("b", "x"), ("a", "")], "key STRING, description STRING")
    assert [tuple(r) for r in cat.upgrade_keys_0_7(keys, order="key").orderBy("idx").collect()] == [("a", "", 1), ("b", "x", 2)]


PATTERNS = [
    (["/foo.tif"], "/{name}.tif", [("foo",)]),
    (["/S2_20180101_B04.tif"], "/{sensor}_{date}_B04.tif", [("S2", "20180101")]),
    (["/S2/20180101_B04.tif"], "/{sensor}/{date}_B04.tif", [("S2", "20180101")]),
    (["/S2/20180101_B04.tif", "/S2/20180101_B05_median.tif"], "/{sensor}/{date}_{band}{}.tif",
     [("S2", "20180101", "B04"), ("S2", "20180101", "B05")]),
    (["/S2/20180101/S2_20180101_B04.tif", "/S2/20180101/S3_20180101_B04.tif"], "/{sensor}/{date}/{sensor}_{date}_{band}.tif",
     [("S2", "20180101", "B04")]),
    (["/bar.tif", "/{foo}.tif"], "/{{{name}}}.tif", [("foo",)]),
    (["/bAr.tif", "/FOO.tif"], "/{nAmE}.tif", [("FOO",), ("bAr",)]),
    (["/süßer ordner/foo.tif"], "/{}/{name}.tif", [("foo",)]),
    (["/günther.tif"], "/{bärbel}.tif", [("günther",)]),
]


@pytest.mark.parametrize("files,pattern,expected", PATTERNS)
def test_pattern(spark, files, pattern, expected):
    paths = spark.createDataFrame([(f,) for f in files], "path STRING")
    out = P.keys_from_paths(paths, pattern)
    assert sorted(tuple(r)[:-1] for r in out.collect()) == expected


@pytest.mark.parametrize("files,pattern,message", [
    ([], "/{key}.tif", "no files"), (["/dir1/foo.tif", "/dir2/foo.tif"], "/{}/{name}.tif", "duplicate keys"),
    (["/S2_B04.tif", "/S2_20180101_B04.tif"], "/{sensor}_{}.tif", "duplicate keys"),
    ([], "notafile.tif", "at least one placeholder"), ([], "{}.tif", "at least one placeholder"),
    ([], "notafile{.tif", "invalid pattern"), (["foo.tif"], "{(foo)}.tif", "must be alphanumeric")])
def test_bad_pattern(spark, files, pattern, message):
    paths = spark.createDataFrame([(f,) for f in files], "path STRING")
    with pytest.raises(ValueError, match=message):
        I.datasets_from_paths(paths, pattern)


def test_list_paths(spark, tmp_path):
    for name in ("S2_a.tif", "S3_b.tif", "other.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = I.datasets_from_paths(P.list_paths(spark, f"{tmp_path}/{{sensor}}_{{band}}.tif"), f"{tmp_path}/{{sensor}}_{{band}}.tif", rgb_key="sensor")
    assert sorted(tuple(r)[:2] for r in found.collect()) == [("a", "S2"), ("b", "S3")]


def test_ingest_without_metadata(spark, tmp_path):
    data = spark.createDataFrame([("a", "/p/a.tif"), ("b", "/p/b.tif")], "name STRING, path STRING")
    root = str(tmp_path / "db")
    I.ingest_into(spark, root, data, skip_metadata=True)
    more = spark.createDataFrame([("b", "/other/b.tif"), ("c", "/p/c.tif")], "name STRING, path STRING")
    out = I.ingest_into(spark, root, more, skip_metadata=True, skip_existing=True)
    assert {tuple(r) for r in out.datasets.collect()} == {("a", "/p/a.tif"), ("b", "/p/b.tif"), ("c", "/p/c.tif")}
    with pytest.raises(CatalogError):
        I.ingest_into(spark, root, data.withColumnRenamed("name", "title"), skip_metadata=True)
