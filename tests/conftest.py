from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from oracle_check import make_session  # noqa: E402

ORIGIN = (694920.0, 2055666.0)


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()


def cells_frame(spark, arrays: dict):
    """Cells of named 2-D arrays; NaN cells stay in, as stored rasters may hold them."""
    parts = []
    for key, a in arrays.items():
        rows, cols = np.indices(a.shape)
        parts.append(pd.DataFrame({"key": key, "row": rows.ravel(), "col": cols.ravel(), "value": a.astype(float).ravel()}))
    out = spark.createDataFrame(pd.concat(parts), "key STRING, row INT, col INT, value DOUBLE")
    return out


def grids_frame(spark, arrays: dict, pixel=2.0, nodata=None, crs="epsg:32637", origin=ORIGIN):
    rows = [(k, a.shape[1], a.shape[0], pixel, 0.0, origin[0], 0.0, -pixel, origin[1], crs, nodata, str(a.dtype), False)
            for k, a in arrays.items()]
    return spark.createDataFrame(rows, "key STRING, width INT, height INT, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, e DOUBLE, "
                                       "f DOUBLE, crs STRING, nodata DOUBLE, dtype STRING, has_alpha BOOLEAN")


def small_raster() -> np.ndarray:
    a = np.arange(-128 * 256, 128 * 256, dtype="int32").reshape(256, 256)
    a.flat[::5] = 10000
    return a


def float_raster() -> np.ndarray:
    a = small_raster().astype(float)
    a[:100, :100] = np.nan
    return a


def circle_raster(n=256, radius=100) -> np.ndarray:
    a = np.random.default_rng(17).integers(0, 65535, (n, n)).astype(float)
    y, x = np.indices(a.shape)
    a[(x - n // 2) ** 2 + (y - n // 2) ** 2 > radius**2] = 10000
    a[n // 4: n // 2, n // 2:] = 10000
    a[n // 2 + 20] = 10000
    return a


def masked(a, nodata=10000):
    a = a.astype(float)
    return np.ma.masked_invalid(np.where(a == nodata, np.nan, a))
