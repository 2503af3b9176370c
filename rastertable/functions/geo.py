"""Projections and tile addresses as closed-form Column expressions.

Supported reference systems: geographic degrees (EPSG:4326), spherical Web
Mercator (EPSG:3857) and WGS84 UTM (EPSG:326zz north, EPSG:327zz south). The
CRS may be a per-dataset column, so one job can mix datasets of all kinds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rastertable.functions.masks import as_column

# fixed values: WGS84 / Web Mercator constants
EARTH_RADIUS = 6378137.0
CIRCUMFERENCE = 2.0 * math.pi * EARTH_RADIUS
FLATTENING = 1.0 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0

MAX_ZOOM = 1023          # above it 2^z leaves the double range
TILE_EPSILON = 1e-14     # points this close to a tile's right edge belong to the next tile
MIN_COVER_RATIO = 0.01   # a dataset covering less of a tile than this is out of bounds

WGS84 = "EPSG:4326"
WEB_MERCATOR = "EPSG:3857"


def _bounded_sin(lat: Column) -> Column:
    return F.sin(F.radians(lat))


# --- tiles ----------------------------------------------------------------

def _tile_index(fraction: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z.cast("double"))
    return (
        F.when(fraction <= 0, F.lit(0.0))
        .when(fraction >= 1, n - 1)
        .otherwise(F.floor((fraction + F.lit(TILE_EPSILON)) * n).cast("double"))
    )


def tile_x(lon, z) -> Column:
    """Column of the tile holding a longitude, as a whole double (safe at any zoom)."""
    return _tile_index(as_column(lon) / F.lit(360.0) + F.lit(0.5), as_column(z))


def tile_y(lat, z) -> Column:
    """Row of the tile holding a latitude; poles fall in the first and last row."""
    lat = as_column(lat)
    s = _bounded_sin(lat)
    inside = F.lit(0.5) - F.lit(0.25) * F.ln((F.lit(1.0) + s) / (F.lit(1.0) - s)) / F.lit(math.pi)
    y = F.when(lat >= 90, F.lit(0.0)).when(lat <= -90, F.lit(1.0)).otherwise(inside)
    return _tile_index(y, as_column(z))


def tile_bounds(z, x, y) -> dict[str, Column]:
    """Web Mercator box of a tile: left, bottom, right, top."""
    z, x, y = (as_column(c).cast("double") for c in (z, x, y))
    size = F.lit(CIRCUMFERENCE) / F.pow(F.lit(2.0), z)
    left = x * size - F.lit(CIRCUMFERENCE / 2)
    top = F.lit(CIRCUMFERENCE / 2) - y * size
    return {"left": left, "bottom": top - size, "right": left + size, "top": top}


def tile_exists(west, south, east, north, x, y, z) -> Column:
    """Whether tile (x, y, z) lies in the tile range of a lon/lat box."""
    x, y, z = (as_column(c).cast("double") for c in (x, y, z))
    return F.when(z > MAX_ZOOM, F.lit(False)).otherwise(
        x.between(tile_x(west, z), tile_x(east, z))
        & y.between(tile_y(north, z), tile_y(south, z))
    )


def cover_ratio(box: tuple, tile: tuple) -> Column:
    """Area of a dataset's whole box over the tile's area (not of their intersection)."""
    l, b, r, t = (as_column(c) for c in box)
    tl, tb, tr, tt = (as_column(c) for c in tile)
    return (r - l) / (tr - tl) * (t - b) / (tt - tb)


# --- pixel <-> coordinate -------------------------------------------------

def pixel_to_xy(col, row, g="") -> tuple[Column, Column]:
    """Affine transform; ``g`` prefixes the coefficient columns a..f."""
    col, row = as_column(col), as_column(row)
    a, b, c, d, e, f = (F.col(g + n) for n in "abcdef")
    return a * col + b * row + c, d * col + e * row + f


def xy_to_pixel(x, y, g="") -> tuple[Column, Column]:
    """Inverse affine transform to fractional (col, row)."""
    x, y = as_column(x), as_column(y)
    a, b, c, d, e, f = (F.col(g + n) for n in "abcdef")
    det = a * e - b * d
    return (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det


# --- Web Mercator ---------------------------------------------------------

def _merc_forward(lon: Column, lat: Column):
    # lat is kept off the poles, where the projection is infinite
    phi = F.radians(F.greatest(F.least(lat, F.lit(89.9999)), F.lit(-89.9999)))
    return (
        F.lit(EARTH_RADIUS) * F.radians(lon),
        F.lit(EARTH_RADIUS) * F.ln(F.tan(F.lit(math.pi / 4) + phi / F.lit(2.0))),
    )


def _merc_inverse(x: Column, y: Column):
    return (
        F.degrees(x / F.lit(EARTH_RADIUS)),
        F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(EARTH_RADIUS))) - F.lit(math.pi / 2)),
    )


# --- transverse Mercator (Krueger series in the third flattening) ---------

_N = FLATTENING / (2.0 - FLATTENING)
_RECTIFYING = EARTH_RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ECC = 2.0 * math.sqrt(_N) / (1.0 + _N)
# fixed values: series coefficients to fourth order in n
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def _utm_zone(crs: Column) -> Column:
    return F.substring(crs, 9, 2).cast("int")


def _utm_false_northing(crs: Column) -> Column:
    return F.when(crs.startswith("EPSG:327"), F.lit(UTM_FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))


def _utm_meridian(crs: Column) -> Column:
    return (_utm_zone(crs) * 6 - 183).cast("double")


def _utm_t(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    return F.sinh(F.atanh(s) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * s))


def _utm_xi_eta(t: Column, dlam: Column) -> tuple[Column, Column]:
    return F.atan2(t, F.cos(dlam)), F.atanh(F.sin(dlam) / F.sqrt(F.lit(1.0) + t * t))


def _utm_series(crs: Column, xi: Column, eta: Column) -> tuple[Column, Column]:
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        north = north + F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    k = F.lit(UTM_SCALE * _RECTIFYING)
    return k * east + F.lit(UTM_FALSE_EASTING), k * north + _utm_false_northing(crs)


def _utm_start(crs: Column, x: Column, y: Column) -> tuple[Column, Column]:
    k = F.lit(UTM_SCALE * _RECTIFYING)
    return (y - _utm_false_northing(crs)) / k, (x - F.lit(UTM_FALSE_EASTING)) / k


def _utm_unseries(xi0: Column, eta0: Column) -> tuple[Column, Column]:
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - F.lit(b) * F.sin(xi0 * (2 * j)) * F.cosh(eta0 * (2 * j))
        eta = eta - F.lit(b) * F.cos(xi0 * (2 * j)) * F.sinh(eta0 * (2 * j))
    return xi, eta


def _utm_unfold(crs: Column, xi: Column, eta: Column, chi: Column) -> tuple[Column, Column]:
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + F.lit(d) * F.sin(chi * (2 * j))
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + _utm_meridian(crs), F.degrees(phi)


# --- conformal conics and polar stereographic; Lambert azimuthal equal-area -------

def _isometric(lat: float) -> float:
    s = math.sin(math.radians(lat))
    return math.atanh(s) - _ECC * math.atanh(_ECC * s)


def _parallel_radius(lat: float) -> float:
    s = math.sin(math.radians(lat))
    return math.cos(math.radians(lat)) / math.sqrt(1 - (_ECC * s) ** 2)


def conic(lon0: float, x0: float, y0: float, parallels: tuple[float, ...], lat0: float | None = None) -> dict[str, float]:
    """Constants of a conformal conic: radius c * exp(-n * isometric latitude) about the pole.

    One standard parallel without ``lat0`` is polar stereographic, which is the conic of n = 1 or -1 with its origin at the pole.
    """
    if lat0 is None:
        n = math.copysign(1.0, parallels[0])
    elif len(parallels) == 2 and parallels[0] != parallels[1]:
        a, b = parallels
        n = (math.log(_parallel_radius(a)) - math.log(_parallel_radius(b))) / (_isometric(b) - _isometric(a))
    else:
        n = math.sin(math.radians(parallels[0]))
    c = EARTH_RADIUS * _parallel_radius(parallels[0]) / n * math.exp(n * _isometric(parallels[0]))
    return {"n": n, "c": c, "rho0": 0.0 if lat0 is None else c * math.exp(-n * _isometric(lat0)), "lon0": lon0, "x0": x0, "y0": y0}


def _authalic(s: float) -> float:
    return (1 - _ECC**2) * (s / (1 - (_ECC * s) ** 2) + math.atanh(_ECC * s) / _ECC)


def equal_area(lon0: float, lat0: float, x0: float, y0: float) -> dict[str, float]:
    """Constants of Lambert's azimuthal equal-area projection about a point off the poles."""
    pole = _authalic(1.0)
    beta = math.asin(_authalic(math.sin(math.radians(lat0))) / pole)
    radius = EARTH_RADIUS * math.sqrt(pole / 2)
    return {"sb": math.sin(beta), "cb": math.cos(beta), "r": radius, "d": EARTH_RADIUS * _parallel_radius(lat0) / (radius * math.cos(beta)),
            "qp": pole, "lon0": lon0, "x0": x0, "y0": y0}


# fixed values: parameters of the systems, by code
CONICS = {
    "EPSG:2154": conic(3.0, 700000.0, 6600000.0, (49.0, 44.0), 46.5),
    "EPSG:3034": conic(10.0, 4000000.0, 2800000.0, (35.0, 65.0), 52.0),
    "EPSG:3031": conic(0.0, 0.0, 0.0, (-71.0,)),
    "EPSG:3413": conic(-45.0, 0.0, 0.0, (70.0,)),
    "EPSG:3995": conic(0.0, 0.0, 0.0, (71.0,)),
}
EQUAL_AREAS = {"EPSG:3035": equal_area(10.0, 52.0, 4321000.0, 3210000.0)}
_E2 = _ECC**2
_AUTHALIC = (_E2 / 3 + 31 * _E2**2 / 180 + 517 * _E2**3 / 5040, 23 * _E2**2 / 360 + 251 * _E2**3 / 3780, 761 * _E2**3 / 45360)


def _parameter(crs: Column, systems: dict, name: str) -> Column:
    """A constant of each row's system."""
    out = None
    for code, values in systems.items():
        out = (F if out is None else out).when(crs == code, F.lit(float(values[name])))
    return out


def _gudermann(psi: Column) -> Column:
    """Latitude (radians) of an isometric latitude."""
    chi = F.asin(F.tanh(psi))
    out = chi
    for j, d in enumerate(_DELTA, 1):
        out = out + F.lit(d) * F.sin(chi * (2 * j))
    return out


def _conic_to_lonlat(df, x: Column, y: Column):
    k = {n: _parameter(normal_crs("crs"), CONICS, n) for n in ("n", "c", "rho0", "lon0", "x0", "y0")}
    df = once(df, _n=k["n"], _dx=x - k["x0"], _dy=k["rho0"] - (y - k["y0"]))
    side = F.signum("_n")
    rho = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    ratio = F.greatest(side * rho / k["c"], F.lit(1e-300))
    df = once(df, _psi=-F.ln(ratio) / F.col("_n"), _theta=F.atan2(side * F.col("_dx"), side * F.col("_dy")))
    return once(df, _lon=F.degrees(F.col("_theta") / F.col("_n")) + k["lon0"], _lat=F.degrees(_gudermann(F.col("_psi")))).drop("_n", "_dx", "_dy", "_psi", "_theta")


def _conic_from_lonlat(df, out_x: str, out_y: str):
    k = {n: _parameter(normal_crs("crs"), CONICS, n) for n in ("n", "c", "rho0", "lon0", "x0", "y0")}
    s = F.sin(F.radians("_lat"))
    # the meridian opposite the central one is where the plane is cut
    turn = F.pmod(F.col("_lon") - k["lon0"] + 180.0, F.lit(360.0)) - 180.0
    df = once(df, _n=k["n"], _psi=F.atanh(s) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * s), _dl=F.radians(turn))
    df = once(df, _rho=k["c"] * F.exp(-F.col("_n") * F.col("_psi")), _theta=F.col("_n") * F.col("_dl"))
    return once(df, **{out_x: k["x0"] + F.col("_rho") * F.sin("_theta"), out_y: k["y0"] + k["rho0"] - F.col("_rho") * F.cos("_theta")}).drop(
        "_n", "_psi", "_dl", "_rho", "_theta", "_lon", "_lat")


def _area_to_lonlat(df, x: Column, y: Column):
    k = {n: _parameter(normal_crs("crs"), EQUAL_AREAS, n) for n in ("sb", "cb", "r", "d", "lon0", "x0", "y0")}
    df = once(df, _dx=(x - k["x0"]) / k["d"], _dy=(y - k["y0"]) * k["d"])
    df = once(df, _rho=F.greatest(F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")), F.lit(1e-9)))
    df = once(df, _ce=2.0 * F.asin(F.least(F.col("_rho") / (2.0 * k["r"]), F.lit(1.0))))
    sc, cc = F.sin("_ce"), F.cos("_ce")
    df = once(df, _beta=F.asin(cc * k["sb"] + F.col("_dy") * sc * k["cb"] / F.col("_rho")),
              _dl=F.atan2(F.col("_dx") * sc, F.col("_rho") * k["cb"] * cc - F.col("_dy") * k["sb"] * sc))
    lat = F.col("_beta")
    for j, a in enumerate(_AUTHALIC, 1):
        lat = lat + F.lit(a) * F.sin(F.col("_beta") * (2 * j))
    return once(df, _lon=F.degrees("_dl") + k["lon0"], _lat=F.degrees(lat)).drop("_dx", "_dy", "_rho", "_ce", "_beta", "_dl")


def _area_from_lonlat(df, out_x: str, out_y: str):
    k = {n: _parameter(normal_crs("crs"), EQUAL_AREAS, n) for n in ("sb", "cb", "r", "d", "qp", "lon0", "x0", "y0")}
    s = F.sin(F.radians("_lat"))
    q = F.lit(1 - _E2) * (s / (F.lit(1.0) - F.lit(_E2) * s * s) + F.atanh(F.lit(_ECC) * s) / F.lit(_ECC))
    df = once(df, _sb=q / k["qp"], _dl=F.radians(F.col("_lon") - k["lon0"]))
    df = once(df, _cb=F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("_sb") * F.col("_sb"))))
    df = once(df, _b=k["r"] * F.sqrt(2.0 / (1.0 + k["sb"] * F.col("_sb") + k["cb"] * F.col("_cb") * F.cos("_dl"))))
    return once(df, **{out_x: k["x0"] + F.col("_b") * k["d"] * F.col("_cb") * F.sin("_dl"),
                       out_y: k["y0"] + F.col("_b") / k["d"] * (k["cb"] * F.col("_sb") - k["sb"] * F.col("_cb") * F.cos("_dl"))}).drop("_sb", "_cb", "_dl", "_b", "_lon", "_lat")


def _is_utm(crs: Column) -> Column:
    return crs.rlike("^EPSG:32[67](0[1-9]|[1-5][0-9]|60)$")


def normal_crs(crs) -> Column:
    """``epsg:4326`` and ``EPSG:4326`` name the same system."""
    return F.upper(as_column(crs))


# --- projecting tables --------------------------------------------------------

SEPARABLE = (WGS84, WEB_MERCATOR)  # boxes stay boxes between these
UTM = "UTM"  # a CRS kind: the zone of each row is read from its ``crs`` column
CONIC, EQUAL_AREA = "CONIC", "EQUAL_AREA"  # likewise: constants by each row's code


def crs_kind(crs: Column) -> Column:
    """WGS84, WEB_MERCATOR, UTM, CONIC, EQUAL_AREA or, for systems not supported, NULL."""
    crs = normal_crs(crs)
    return (F.when(crs.isin(WGS84, WEB_MERCATOR), crs).when(_is_utm(crs), F.lit(UTM))
            .when(crs.isin(*CONICS), F.lit(CONIC)).when(crs.isin(*EQUAL_AREAS), F.lit(EQUAL_AREA)))


def once(df, **columns: Column):
    """Add columns so that each is computed once per row.

    The optimizer copies a projected expression into every place that
    mentions it once a filter is pushed past it, which multiplies long
    formulas. It does not push filters past a generator, here one that makes
    exactly one row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _zone(crs: str) -> Column:
    return normal_crs("crs") if crs == UTM else F.lit(crs)


def _table_to_lonlat(df, crs: str, x: Column, y: Column):
    """Adds _lon, _lat."""
    if crs == WGS84:
        return once(df, _lon=x, _lat=y)
    if crs == WEB_MERCATOR:
        lon, lat = _merc_inverse(x, y)
        return once(df, _lon=lon, _lat=lat)
    if crs == CONIC:
        return _conic_to_lonlat(df, x, y)
    if crs == EQUAL_AREA:
        return _area_to_lonlat(df, x, y)
    xi0, eta0 = _utm_start(_zone(crs), x, y)
    df = once(df, _xi0=xi0, _eta0=eta0)
    xi, eta = _utm_unseries(F.col("_xi0"), F.col("_eta0"))
    df = once(df, _xi=xi, _eta=eta)
    df = once(df, _chi=F.asin(F.sin("_xi") / F.cosh("_eta")))
    lon, lat = _utm_unfold(_zone(crs), F.col("_xi"), F.col("_eta"), F.col("_chi"))
    return once(df, _lon=lon, _lat=lat).drop("_xi0", "_eta0", "_xi", "_eta", "_chi")


def _table_from_lonlat(df, crs: str, out_x: str, out_y: str):
    """Turns _lon, _lat into out_x, out_y."""
    lon, lat = F.col("_lon"), F.col("_lat")
    if crs == WGS84:
        return df.withColumnsRenamed({"_lon": out_x, "_lat": out_y})
    if crs == WEB_MERCATOR:
        x, y = _merc_forward(lon, lat)
        return once(df, **{out_x: x, out_y: y}).drop("_lon", "_lat")
    if crs == CONIC:
        return _conic_from_lonlat(df, out_x, out_y)
    if crs == EQUAL_AREA:
        return _area_from_lonlat(df, out_x, out_y)
    df = once(df, _t=_utm_t(lat))
    xi, eta = _utm_xi_eta(F.col("_t"), F.radians(lon - _utm_meridian(_zone(crs))))
    df = once(df, _xi=xi, _eta=eta)
    x, y = _utm_series(_zone(crs), F.col("_xi"), F.col("_eta"))
    return once(df, **{out_x: x, out_y: y}).drop("_t", "_xi", "_eta", "_lon", "_lat")


def project(df, source: str, target: str, x: Column, y: Column, out_x: str, out_y: str):
    """Add projected coordinates to a table. Systems are WGS84, WEB_MERCATOR, one UTM code, or UTM, CONIC or EQUAL_AREA, whose code is read from ``crs``."""
    if source == target and source not in (UTM, CONIC, EQUAL_AREA):
        return df.withColumns({out_x: x, out_y: y})
    return _table_from_lonlat(_table_to_lonlat(df, source, x, y), target, out_x, out_y)


def mercator_to_pixel(df, crs: str, x: Column, y: Column, u: str, v: str):
    """Add the fractional source column ``u`` and row ``v`` of Web Mercator points, by header columns a..f."""
    if crs in SEPARABLE:
        px, py = (x, y) if crs == WEB_MERCATOR else _merc_inverse(x, y)
        cu, cv = xy_to_pixel(px, py)
        return once(df, **{u: cu, v: cv})
    df = project(df, WEB_MERCATOR, crs, x, y, "_px", "_py")
    cu, cv = xy_to_pixel("_px", "_py")
    return once(df, **{u: cu, v: cv}).drop("_px", "_py")


def separable_lonlat(crs: str, x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees of a point for the systems whose longitude depends on x and latitude on y alone."""
    return (x, y) if crs == WGS84 else _merc_inverse(x, y)


def separable_mercator(crs: str, x: Column, y: Column) -> tuple[Column, Column]:
    return (x, y) if crs == WEB_MERCATOR else _merc_forward(x, y)
