"""The service facade and streaming ingest, end to end on small rasters."""

import numpy as np
import pytest
from conftest import cells_frame, grids_frame
from pyspark.sql import functions as F

from rastertable.api import RasterService
from rastertable.functions import algebra as B
from rastertable.operators import layout, overviews, stats
from rastertable.operators.catalog import Catalog, CatalogError
from rastertable.sources.cells import pack_blocks
from rastertable.streaming.ingest import new_datasets, start_ingest, streamed_percentiles, streamed_stats

KEYS = ["scene", "band"]


@pytest.fixture(scope="module")
def service(spark):
    rng = np.random.default_rng(2)
    arrays = {f"s|{b}": rng.random((64, 64)) * 100 for b in "rgb"}
    split = lambda df: df.withColumns({"scene": F.split_part("key", F.lit("|"), F.lit(1)), "band": F.split_part("key", F.lit("|"), F.lit(2))}).drop("key")
    cells = split(cells_frame(spark, arrays))
    grids = split(grids_frame(spark, arrays, crs="EPSG:3857", pixel=10.0, origin=(1000000.0, 6000000.0)))
    catalog = Catalog.create(spark, KEYS).insert(grids.select(*KEYS, F.lit("p").alias("path")))
    raw = RasterService(catalog, pack_blocks(cells, KEYS, 32), grids, block_size=32, tile_size=(16, 16))
    return raw.with_missing_metadata(cells), arrays


def test_catalog_questions(service):
    s, _ = service
    assert s.datasets({"band": ["r", "g"]}).count() == 2 and s.keys().count() == 2
    assert s.metadata(("s", "r"), ["min", "max"]).columns == ["min", "max", "keys"]
    assert s.metadata_batch([("s", "b"), ("s", "r")], ["mean"]).count() == 2
    assert s.colormap((0, 1), "jet", 50).count() == 50


def test_images(service):
    s, arrays = service
    preview = s.singleband({"band": "r"}).collect()
    assert len(preview) == 256 and all(1 <= r["index"] <= 255 and r["a"] == 255 for r in preview)
    rgb = s.rgb(["s"], ["r", "g", "b"]).collect()
    assert len(rgb) == 256 and set(rgb[0].asDict()) == {"scene", "py", "px", "r", "g", "b", "a"}
    computed = {(r["py"], r["px"]): r["index"] for r in s.compute(lambda v1, v2: B.add(v1, v2), ["s"], {"v1": "r", "v2": "g"}, (0, 200)).collect()}
    mean = (arrays["s|r"] + arrays["s|g"]).reshape(16, 4, 16, 4).mean(axis=(1, 3))
    want = np.rint((mean / 200) * 254 + 1)
    assert all(abs(computed[(i, j)] - want[i, j]) <= 1 for i in range(16) for j in range(16))
    with pytest.raises(CatalogError):
        s.rgb([], ["r", "g", "b"])


def test_statistics_on_demand(service):
    """Datasets without statistics get them from their blocks; unknown datasets and bands are errors."""
    s, _ = service
    bare = RasterService(Catalog(s.catalog.key_names, s.catalog.datasets, s.catalog.metadata.limit(0), s.catalog.catalog_version), s.blocks, s.grids, s.block_size,
                         tile_size=s.tile_size)
    assert sorted(map(tuple, bare.singleband({"band": "r"}).collect())) == sorted(map(tuple, s.singleband({"band": "r"}).collect()))
    assert sorted(map(tuple, bare.rgb(["s"], ["r", "g", "b"]).collect())) == sorted(map(tuple, s.rgb(["s"], ["r", "g", "b"]).collect()))
    assert bare.singleband(stretch_range=(0, 10)).count() == s.singleband(stretch_range=(0, 10)).count() > 0
    for wrong in (lambda: bare.metadata(("no", "no")), lambda: s.singleband({"band": "no"}), lambda: s.rgb(["s"], ["r", "g", "no"]),
                  lambda: s.compute(lambda v1: v1, ["s"], {"v1": "no"}, (0, 1))):
        with pytest.raises(CatalogError):
            wrong()


def test_stored_service_and_complete_tiles(spark, service, tmp_path):
    """A service over a stored table with overviews answers as one over a table in memory; complete tiles have all their pixels."""
    s, _ = service
    base = s.blocks.withColumn("level", F.lit(0))
    levels = base.unionByName(overviews.overview_blocks(s.blocks, s.grids, KEYS, "average", 32).select(*base.columns))
    path = str(tmp_path / "t")
    layout.write_blocks(levels, s.grids, KEYS, path)
    stored, leveled = (RasterService(s.catalog, b, s.grids, 32, tile_size=(16, 16)) for b in (path, levels))
    at = lambda z: (int((1000000 + 20037508.34) // (40075016.68557849 / 2**z)), int((20037508.34 - 6000000) // (40075016.68557849 / 2**z)), z)
    for z in (12, 16):
        some = [at(z), (0, 0, z)]
        want = sorted(map(tuple, leveled.singleband({"band": ["r", "g"]}, some).collect()))
        assert want and want == sorted(map(tuple, stored.singleband({"band": ["r", "g"]}, some).collect()))
    full = stored.singleband({"band": ["r", "g"]}, some, complete=True).collect()
    assert len(full) == 2 * 2 * 256 and sorted(tuple(r) for r in full if r["a"]) == [r for r in want if r[-1]]
    assert {(r["index"], r["a"]) for r in full if r["x"] == 0} == {(0, 0)}
    rgb = stored.rgb(["s"], ["r", "g", "b"], some, complete=True).collect()
    assert len(rgb) == 2 * 256 and {tuple(r)[-4:] for r in rgb if r["x"] == 0} == {(0, 0, 0, 0)}
    assert len(stored.compute(lambda v1: v1, ["s"], {"v1": "r"}, (0, 100), complete=True).collect()) == 256


def test_tiles_and_out_of_bounds(service):
    s, _ = service
    size = 40075016.68557849 / 2**16
    x, y = int((1000000 + 20037508.34) // size), int((20037508.34 - 6000000) // size)
    inside = s.singleband({"band": "r"}, [(x, y, 16)])
    assert inside.count() > 0 and {"z", "x", "y", "py", "px"} <= set(inside.columns)
    assert s.singleband({"band": "r"}, [(10, 0, 0)]).isEmpty()


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    arrays = {"a": rng.random((40, 40)), "b": rng.random((30, 10))}
    cells = cells_frame(spark, arrays).cache()
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    cells.where("row < 20").coalesce(1).write.parquet(source)
    stream = lambda: start_ingest(spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(source), ["key"], root, 8)
    stream().awaitTermination()
    cells.where("row >= 20").repartition(3).write.parquet(source, mode="append")
    stream().awaitTermination()
    got = {r["key"]: r for r in streamed_stats(spark, root, ["key"]).collect()}
    for r in stats.moments(cells, ["key"]).collect():
        g = got[r["key"]]
        assert (g["n_valid"], g["min"], g["max"]) == (r["n_valid"], r["min"], r["max"])
        assert g["mean"] == pytest.approx(r["mean"]) and g["stdev"] == pytest.approx(r["stdev"])
    p = {r["key"]: r["percentiles"] for r in streamed_percentiles(spark, root, ["key"]).collect()}
    np.testing.assert_allclose(p["a"], np.percentile(arrays["a"], np.arange(1, 100)), atol=0.05)
    known = spark.createDataFrame([("a",)], "key STRING")
    assert [r["key"] for r in new_datasets(spark, root, ["key"], known).collect()] == ["b"]


def test_masked_block_replaces_the_one_before(spark, tmp_path):
    """A block that comes again wholly masked takes its pixels out of the statistics."""
    schema, source, root = "key STRING, row INT, col INT, value DOUBLE", str(tmp_path / "in"), str(tmp_path / "out")
    for values in ([5.0, 7.0], [None, None]):
        spark.createDataFrame([("a", 0, i, v) for i, v in enumerate(values)] + [("b", 0, 0, 1.0)], schema).coalesce(1).write.parquet(source, mode="append")
        start_ingest(spark.readStream.schema(schema).parquet(source), ["key"], root, 4).awaitTermination()
    got = {r.key: r.n_valid for r in streamed_stats(spark, root, ["key"], newest=True).collect()}
    assert got == {"b": 1}
    assert {r.key for r in streamed_percentiles(spark, root, ["key"], newest=True).collect()} == {"b"}
