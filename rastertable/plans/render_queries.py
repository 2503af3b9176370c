"""Stretching, labels, colour maps and composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastertable.functions import algebra as B
from rastertable.functions import color as C
from rastertable.operators import colormaps as M
from rastertable.operators import render, stats
from rastertable.operators import transforms as T
from rastertable.operators.bands import align_bands
from rastertable.plans import adapters as A
from rastertable.plans.registry import query

LABELS = [0.05, 0.0, 0.1, 0.07]
LABEL_COLORS = [(255, 0, 0), (0, 255, 0, 128), "#0a0b0c", (1, 2, 3)]


def _meta(spark, d, percentiles="none"):
    out = stats.dataset_stats(A.a2_cells(spark, d), A.a2_grids(spark, d), A.A2_KEYS, percentiles)
    if percentiles == "none":
        out = out.withColumn("percentiles", F.lit(None).cast("array<double>"))
    return out


def _a1_meta(spark, d):
    return stats.dataset_stats(A.a1_cells(spark, d), A.a1_grids(spark, d), A.A1_KEYS)


def stretch_sql(v, lo, hi, a, b):
    """Same steps as the Column form; the span is never flat in the test data."""
    a, b = (f"CAST({x} AS DOUBLE)" for x in (a, b))
    return f"CASE WHEN ({v}) IS NOT NULL THEN least(greatest((({v}) - {lo}) * (({b} - {a}) / ({hi} - {lo})) + {a}, {a}), {b}) END"


def uint8_sql(v, lo, hi):
    return f"coalesce(CAST(round_even({stretch_sql(v, lo, hi, 1, 255)}, 0) AS INTEGER), 0)"


def quantised_sql(v, lo, hi):
    """Stretch to [0, 1], then to 1..255, as rendering does."""
    return uint8_sql(stretch_sql(v, lo, hi, 0, 1), "CAST(0 AS DOUBLE)", "CAST(1 AS DOUBLE)")


@query("stretch", f"""WITH {A.A2_SQL}, {A.A2_META_SQL}
SELECT scene, band, "row", col, round({stretch_sql('value', 'min', 'max', 10, 20)}, 6) AS clipped,
       round((value - 5) * (10 / CAST(1 AS DOUBLE)) + 10, 4) AS free, value - 5 + 10 AS flat
FROM a2 JOIN m2 USING (scene, band)""")
def stretch(spark, d):
    joined = A.a2_cells(spark, d).join(_meta(spark, d).select(*A.A2_KEYS, "min", "max"), A.A2_KEYS)
    return joined.select(
        *A.A2_KEYS, "row", "col",
        F.round(C.contrast_stretch("value", "min", "max", F.lit(10.0), F.lit(20.0)), 6).alias("clipped"),
        F.round(C.contrast_stretch("value", F.lit(5.0), F.lit(6.0), F.lit(10.0), F.lit(20.0), clip=False), 4).alias("free"),
        C.contrast_stretch("value", F.lit(5.0), F.lit(5.0), F.lit(10.0), F.lit(20.0), clip=False).alias("flat"))


@query("to_uint8", f"""WITH {A.A1_SQL}, m AS (SELECT scene, min(value) AS lo, max(value) AS hi FROM a1 GROUP BY 1)
SELECT scene, "row", col, {uint8_sql('value', 'lo', 'hi')} AS index FROM a1 JOIN m USING (scene)""")
def to_uint8(spark, d):
    cells = A.a1_cells(spark, d)
    joined = cells.join(stats.moments(cells, A.A1_KEYS), A.A1_KEYS)
    return joined.select("scene", "row", "col", C.to_uint8("value", "min", "max").alias("index"))


@query("percentile_stretch", f"""WITH {A.A1_SQL},
m AS (SELECT scene, quantile_cont(value, 0.03) AS lo, quantile_cont(value, 0.98) AS hi FROM a1 GROUP BY 1)
SELECT scene, "row", col, {quantised_sql('value', 'lo', 'hi')} AS index FROM a1 JOIN m USING (scene)""")
def percentile_stretch(spark, d):
    return render.singleband(A.a1_cells(spark, d), _a1_meta(spark, d), A.A1_KEYS,
                             stretch_range=("p2", "p97")).select("scene", "row", "col", "index")


_LABEL_CASE = " ".join(f"WHEN value = CAST('{v}' AS DOUBLE) THEN {i}" for i, v in enumerate(LABELS, 1))


@query("labels", f"""WITH {A.A2_SQL}
SELECT scene, band, "row", col, CASE {_LABEL_CASE} ELSE 0 END AS index FROM a2""")
def labels(spark, d):
    return A.a2_cells(spark, d).select(*A.A2_KEYS, "row", "col", C.label("value", LABELS).alias("index"))


@query("colour_explicit", f"""WITH {A.A2_SQL}, l AS (
  SELECT scene, band, "row", col, CASE {_LABEL_CASE} ELSE 0 END AS index FROM a2),
m(index, r, g, b, a) AS (VALUES (1, 255, 0, 0, 255), (2, 0, 255, 0, 128), (3, 10, 11, 12, 255), (4, 1, 2, 3, 255))
SELECT scene, band, "row", col, index, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a
FROM l LEFT JOIN m USING (index)""")
def colour_explicit(spark, d):
    return render.singleband(A.a2_cells(spark, d), _meta(spark, d), A.A2_KEYS, colormap=dict(zip(LABELS, LABEL_COLORS)))


@query("singleband", f"""WITH {A.A2_SQL}, {A.A2_META_SQL}, q AS (
  SELECT scene, band, "row", col, {quantised_sql('value', 'min', 'max')} AS index FROM a2 JOIN m2 USING (scene, band))
SELECT *, index AS r, index AS g, index AS b, CASE WHEN index = 0 THEN 0 ELSE 255 END AS a FROM q""")
def singleband(spark, d):
    return render.singleband(A.a2_cells(spark, d), _meta(spark, d), A.A2_KEYS)


COOL_SQL = """lut AS (SELECT i AS idx, least(CAST(floor(i / CAST(254 AS DOUBLE) * 256) AS INTEGER), 255) AS e FROM range(0, 255) t(i)),
cool AS (SELECT idx + 1 AS index, CAST(floor(e / CAST(255 AS DOUBLE) * 255) AS INTEGER) AS r,
         CAST(floor((e / CAST(255 AS DOUBLE) * -1 + 1) * 255) AS INTEGER) AS g, 255 AS b, 255 AS a FROM lut)"""


@query("colour_apply", f"""WITH {A.A1_SQL}, m AS (SELECT scene, max(value) AS hi FROM a1 GROUP BY 1), {COOL_SQL},
q AS (SELECT scene, "row", col, {quantised_sql('CASE WHEN value >= 0 THEN value END', "CAST(0 AS DOUBLE)", 'hi')} AS index FROM a1 JOIN m USING (scene))
SELECT scene, "row", col, q.index, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a
FROM q LEFT JOIN cool ON q.index = cool.index""")
def colour_apply(spark, d):
    cells = A.a1_cells(spark, d).withColumn("value", F.when(F.col("value") >= 0, F.col("value")))
    return render.singleband(cells, _a1_meta(spark, d), A.A1_KEYS, stretch_range=(0, None), colormap="Cool")


@query("colour_bar", f"""WITH {A.A1_SQL}, m AS (SELECT scene, min(value) AS lo, max(value) AS hi FROM a1 GROUP BY 1), {COOL_SQL},
bar AS (SELECT scene, i AS ord, CASE WHEN i = 254 THEN hi ELSE i * ((hi - lo) / 254) + lo END AS value, lo, hi FROM m, range(0, 255) t(i))
SELECT scene, CAST(ord AS INTEGER) AS ord, round(value, 6) AS value, r, g, b, a
FROM bar JOIN cool ON cool.index = {uint8_sql('value', 'lo', 'hi')}""")
def colour_bar(spark, d):
    ranges = stats.moments(A.a1_cells(spark, d), A.A1_KEYS)
    bars = M.color_bars(ranges, A.A1_KEYS, M.one_map(M.builtin_colormaps(spark), "cool"))
    return bars.withColumn("value", F.round("value", 6))


_RGB_ORDER = ("price", "discount", "tax")


def _rgb_sql(transform):
    parts = ", ".join(f"{transform(stretch_sql(n, f'm{n}.min', f'm{n}.max', 0, 1))} AS {c}" for n, c in zip(_RGB_ORDER, "rgb"))
    joins = " ".join(f"JOIN m2 m{n} ON m{n}.scene = px.scene AND m{n}.band = '{n}'" for n in _RGB_ORDER)
    return f"""WITH {A.A2_SQL}, {A.A2_META_SQL}, u AS (SELECT px.scene, px."row", px.col, {parts} FROM px {joins})"""


_U8 = [f"{uint8_sql(c, 'CAST(0 AS DOUBLE)', 'CAST(1 AS DOUBLE)')} AS {c}" for c in "rgb"]


@query("rgb", f"""{_rgb_sql(lambda s: s)}, o AS (SELECT scene, "row", col, {', '.join(_U8)} FROM u)
SELECT *, CASE WHEN r = 0 AND g = 0 AND b = 0 THEN 0 ELSE 255 END AS a FROM o""")
def rgb(spark, d):
    return render.rgb(A.a2_cells(spark, d), _meta(spark, d), A.A2_KEYS, _RGB_ORDER)


@query("gamma", f"""{_rgb_sql(lambda s: f'power({s}, 1 / CAST(2.2 AS DOUBLE))')}
SELECT scene, "row", col, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM u""")
def gamma(spark, d):
    return _unit_rgb(spark, d, [T.gamma("rgb", 2.2)])


def _sigmoid_sql(v, contrast, bias):
    f = lambda t: f"(1 / (1 + exp({contrast} * ({bias} - {t}))))"
    return f"(({f(v)} - {f('0')}) / ({f('1')} - {f('0')}))"


@query("sigmoidal", f"""{_rgb_sql(lambda s: _sigmoid_sql(s, 'CAST(6 AS DOUBLE)', "CAST('0.4' AS DOUBLE)"))}
SELECT scene, "row", col, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM u""")
def sigmoidal(spark, d):
    return _unit_rgb(spark, d, [T.sigmoidal("rgb", 6, 0.4)])


def _unit_rgb(spark, d, transforms):
    """Stretched bands in [0, 1] after a colour transform, before quantising."""
    bands = align_bands(A.a2_cells(spark, d), A.A2_KEYS, dict(zip("rgb", _RGB_ORDER)))
    meta = _meta(spark, d)
    ranges = meta.groupBy("scene").agg(*[
        F.max_by(F.struct("min", "max"), F.when(F.col("band") == n, F.lit(1))).alias(f"_{c}") for n, c in zip(_RGB_ORDER, "rgb")])
    unit = [C.contrast_stretch(c, f"_{c}.min", f"_{c}.max", F.lit(0.0), F.lit(1.0)) for c in "rgb"]
    out = bands.join(ranges, "scene").withColumns(dict(zip("rgb", unit)))
    return T.apply_transforms(out, transforms, list("rgb")).select(
        "scene", "row", "col", *[F.round(c, 6).alias(c) for c in "rgb"])


def _saturation_sql(p):
    d = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    lin = lambda c: f"CASE WHEN {c} <= {d(0.04045)} THEN {c} / {d(12.92)} ELSE power(({c} + {d(0.055)}) / {d(1.055)}, {d(2.4)}) END"
    f = lambda t: f"CASE WHEN {t} > {d(216 / 24389)} THEN cbrt({t}) ELSE ({d(24389 / 27)} * {t} + 16) / 116 END"
    inv = lambda t: f"CASE WHEN power({t}, 3) > {d(216 / 24389)} THEN power({t}, 3) ELSE (116 * {t} - 16) / {d(24389 / 27)} END"
    enc = lambda t: (f"least(greatest(CASE WHEN {t} <= {d(0.0031308)} THEN {t} * {d(12.92)} "
                     f"ELSE {d(1.055)} * power({t}, {d(1 / 2.4)}) - {d(0.055)} END, 0), 1)")
    return f""", lin AS (SELECT scene, "row", col, {lin('r')} AS r, {lin('g')} AS g, {lin('b')} AS b FROM u),
xyz AS (SELECT *, ({d(0.4124564)} * r + {d(0.3575761)} * g + {d(0.1804375)} * b) / {d(0.95047)} AS x,
  {d(0.2126729)} * r + {d(0.7151522)} * g + {d(0.0721750)} * b AS y,
  ({d(0.0193339)} * r + {d(0.1191920)} * g + {d(0.9503041)} * b) / {d(1.08883)} AS z FROM lin),
lab AS (SELECT scene, "row", col, {f('x')} AS fx, {f('y')} AS fy, {f('z')} AS fz FROM xyz),
cut AS (SELECT scene, "row", col, fy + (fx - fy) * {d(p)} AS fx, fy, fy - (fy - fz) * {d(p)} AS fz FROM lab),
back AS (SELECT scene, "row", col, ({inv('fx')}) * {d(0.95047)} AS x, {inv('fy')} AS y, ({inv('fz')}) * {d(1.08883)} AS z FROM cut),
out AS (SELECT scene, "row", col, {d(3.2404542)} * x - {d(1.5371385)} * y - {d(0.4985314)} * z AS r,
  {d(-0.9692660)} * x + {d(1.8760108)} * y + {d(0.0415560)} * z AS g,
  {d(0.0556434)} * x - {d(0.2040259)} * y + {d(1.0572252)} * z AS b FROM back)
SELECT scene, "row", col, round({enc('r')}, 6) AS r, round({enc('g')}, 6) AS g, round({enc('b')}, 6) AS b FROM out"""


@query("saturation", _rgb_sql(lambda s: s) + _saturation_sql(0.5))
def saturation(spark, d):
    return _unit_rgb(spark, d, [T.saturation(0.5)])


@query("computed_band", f"""WITH {A.A2_SQL}, q AS (
  SELECT scene, "row", col, {uint8_sql("CASE WHEN price + discount * 100000 <> 0 THEN (price - discount * 100000) / (price + discount * 100000) END", "CAST(-1 AS DOUBLE)", "CAST(1 AS DOUBLE)")} AS index FROM px)
SELECT *, index AS r, index AS g, index AS b, CASE WHEN index = 0 THEN 0 ELSE 255 END AS a FROM q""")
def computed_band(spark, d):
    def difference(v1, v2):
        v2 = B.multiply(v2, 100000)
        return B.divide(B.subtract(v1, v2), B.add(v1, v2))

    return render.compute(A.a2_cells(spark, d), A.A2_KEYS, {"v1": "price", "v2": "discount"}, difference, (-1, 1))


@query("colormap_override", f"""
WITH ids AS (SELECT unnest(range(0, 255)) AS idx),
own AS (SELECT 'jet' AS name, idx, idx AS r, 254 - idx AS g, CAST(p_size AS INTEGER) AS b FROM ids JOIN part ON p_partkey = idx + 1
  UNION ALL SELECT 'short', idx, idx, idx, idx FROM ids WHERE idx < 100)
SELECT name, CAST(count(*) AS BIGINT) AS n_rows, count(*) = 255 AS valid, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b FROM own GROUP BY 1""")
def colormap_override(spark, d):
    """A shipped map replaced by one made from a table, and one that is too short; the audit tells."""
    sizes = A.table(spark, d, "part").where("p_partkey BETWEEN 1 AND 255").select((F.col("p_partkey") - 1).cast("int").alias("idx"), F.col("p_size").cast("int").alias("b"))
    jet = sizes.select(F.lit("JET").alias("name"), "idx", F.col("idx").alias("r"), (254 - F.col("idx")).alias("g"), "b", F.lit(255).alias("a"))
    short = spark.range(100).select(F.lit("short").alias("name"), *[F.col("id").cast("int").alias(c) for c in ("idx", "r", "g", "b")], F.lit(255).alias("a"))
    maps = M.override(M.builtin_colormaps(spark, ["jet"]), jet.unionByName(short))
    sums = maps.groupBy("name").agg(*[F.sum(c).alias(c) for c in "rgb"])
    return M.colormap_audit(maps).join(sums, "name")
