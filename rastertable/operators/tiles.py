"""Web Mercator tiles out of raster blocks, for whole layers at once.

A *frame* is one output image of one dataset: a tile, or the whole dataset for
previews and reprojection. It is made in two steps, as the reference system
does: the source is resampled to a working grid aligned with the frame, about
as fine as the source, and the working grid is then reduced to the frame's
pixels.

Source pixels never move one by one. Frames are cut into chunks of at most
CHUNK x CHUNK working pixels; each chunk is matched with the few source blocks
under it by an equi-join, and its pixels are only spelled out next to the
block arrays they read. What is shuffled are block rows, then partial sums per
working pixel, then partial sums per frame pixel, both combined before the
shuffle. No step gathers a dataset or a tile in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertable.functions import geo
from rastertable.functions.masks import read_mask
from rastertable.operators.crs import per_crs
from rastertable.operators.halo import masked_values, with_halo
from rastertable.operators.stats import box_edges, located_grids
from rastertable.sources.cells import BLOCK_SIZE

# fixed values
TILE_SIZE = (256, 256)
METHODS = ("nearest", "linear", "cubic", "average")
CUBIC_A = -0.5
CHUNK = 256           # side of a chunk of working pixels
MIN_WEIGHT = 1e-9

HEADER = (*"abcdef", "crs", "width", "height")
MASKS = ("nodata", "has_alpha")  # header columns that not every grid table has


def check_method(method: str) -> str:
    if method not in METHODS:
        raise ValueError(f"unknown resampling method {method!r}, choose from {METHODS}")
    return method


# --- kernels ----------------------------------------------------------------

def linear_weight(t: Column) -> Column:
    t = F.abs(t)
    return F.when(t < 1, F.lit(1.0) - t).otherwise(F.lit(0.0))


def cubic_weight(t: Column) -> Column:
    """Cubic convolution with a = -1/2."""
    t, a = F.abs(t), CUBIC_A
    near = F.lit(a + 2) * t * t * t - F.lit(a + 3) * t * t + F.lit(1.0)
    far = F.lit(a) * t * t * t - F.lit(5 * a) * t * t + F.lit(8 * a) * t - F.lit(4 * a)
    return F.when(t < 1, near).when(t < 2, far).otherwise(F.lit(0.0))


# --- frames -----------------------------------------------------------------

def tile_cover(bounds: DataFrame, zooms: Sequence[int]) -> DataFrame:
    """Rows of ``bounds`` (west, south, east, north in degrees) times the tiles z, x, y under them."""
    z = F.col("z")
    span = lambda lo, hi: F.sequence(lo.cast("long"), hi.cast("long"))
    return (
        bounds.withColumn("z", F.explode(F.array(*[F.lit(int(v)) for v in zooms])))
        .withColumn("x", F.explode(span(geo.tile_x("west", z), geo.tile_x("east", z))))
        .withColumn("y", F.explode(span(geo.tile_y("north", z), geo.tile_y("south", z)))))


def tiles_in_bounds(requests: DataFrame, bounds: DataFrame, keys) -> DataFrame:
    """Requested tiles (keys, z, x, y) with whether each lies inside its dataset's bounds."""
    inside = geo.tile_exists("west", "south", "east", "north", "x", "y", "z")
    return requests.join(bounds, list(keys)).withColumn("exists", inside).select(*keys, "z", "x", "y", "exists")


def tiles_with_datasets(tiles: DataFrame, bounds: DataFrame, keys, zooms: Sequence[int]) -> DataFrame:
    """Which datasets lie under which wanted tiles.

    A dataset is known by the few coarser tiles under it, at the finest zoom
    where it reaches over no more than two of them either way; a wanted tile by
    all its parents. They meet in an equi-join, and tile ranges decide.
    """
    z = F.col("z")
    ranges = bounds.withColumn("z", F.explode(F.array(*[F.lit(int(v)) for v in zooms]))).withColumns({
        "_x0": geo.tile_x("west", z).cast("long"), "_x1": geo.tile_x("east", z).cast("long"),
        "_y0": geo.tile_y("north", z).cast("long"), "_y1": geo.tile_y("south", z).cast("long")})
    reach = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(0).cast("long"))
    ranges = ranges.withColumn("_up", F.least(F.when(reach > 0, F.length(F.bin(reach))).otherwise(F.lit(0)), z))
    parent = lambda c, n: F.call_function("shiftright", F.col(c), n)
    coarse = (ranges.withColumn("_px", F.explode(F.sequence(parent("_x0", F.col("_up")), parent("_x1", F.col("_up")))))
              .withColumn("_py", F.explode(F.sequence(parent("_y0", F.col("_up")), parent("_y1", F.col("_up"))))))
    wanted = (tiles.select(z.cast("int").alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct()
              .withColumn("_up", F.explode(F.sequence(F.lit(0), z)))
              .withColumns({"_px": parent("x", F.col("_up")), "_py": parent("y", F.col("_up"))}))
    return (wanted.join(coarse.select(*keys, "z", "_up", "_px", "_py", "_x0", "_x1", "_y0", "_y1"), ["z", "_up", "_px", "_py"])
            .where("x BETWEEN _x0 AND _x1 AND y BETWEEN _y0 AND _y1").select("z", "x", "y", *keys))


def _working_size(framed: DataFrame, tile_size) -> DataFrame:
    """Adds vw, vh, the working pixels, and ``fine``: the working grid is the frame itself."""
    th, tw = (int(v) for v in tile_size)
    sx, sy = F.col("right") - F.col("left"), F.col("top") - F.col("bottom")
    fine = (sx / tw < F.col("res")) | (sy / th < F.col("res"))
    pixels = lambda span, own: F.when(F.col("fine"), F.lit(own)).otherwise(
        F.greatest(F.rint(span / F.col("res")).cast("int"), F.lit(1)))
    return framed.withColumn("fine", fine).withColumns({"vw": pixels(sx, tw), "vh": pixels(sy, th)})


def _box_ratio() -> Column:
    return geo.cover_ratio(("ml", "mb", "mr", "mt"), ("left", "bottom", "right", "top"))


def sparse_tiles(grids: DataFrame, keys, zooms: Sequence[int], crs: str | None = None) -> DataFrame:
    """Tile cover with the cover ratio and whether the dataset is too small for the tile."""
    framed = tile_cover(located_grids(grids, keys, crs), zooms).withColumns(geo.tile_bounds("z", "x", "y"))
    return framed.withColumn("cover_ratio", _box_ratio()).select(
        *keys, "z", "x", "y", "cover_ratio", (F.col("cover_ratio") < geo.MIN_COVER_RATIO).alias("sparse"))


def tile_frames(grids: DataFrame, keys, zooms: Sequence[int], tile_size=TILE_SIZE,
                crs: str | None = None, tiles: DataFrame | None = None, min_cover: float = 0.0) -> DataFrame:
    """Frames for the tile cover of every dataset, or for the wanted ``tiles`` (keys, z, x, y).

    Tiles outside the dataset's tile range are left out, and so are tiles of
    which it covers less than ``min_cover``.
    """
    keys = list(keys)
    located = located_grids(grids, keys, crs)
    if tiles is None:
        cover = tile_cover(located, zooms)
    else:
        z = F.col("z")
        cover = (located.join(tiles.where(z.isin([int(v) for v in zooms])).select(*keys, "z", "x", "y").distinct(), keys)
                 .where(F.col("x").between(geo.tile_x("west", z), geo.tile_x("east", z))
                        & F.col("y").between(geo.tile_y("north", z), geo.tile_y("south", z))))
    framed = cover.withColumns(geo.tile_bounds("z", "x", "y"))
    if min_cover > 0:
        framed = framed.where(_box_ratio() >= min_cover)
    return _working_size(framed, tile_size)


def _own_box(grids: DataFrame, keys, crs) -> DataFrame:
    return located_grids(grids, keys, crs).withColumns(
        {"left": F.col("ml"), "bottom": F.col("mb"), "right": F.col("mr"), "top": F.col("mt")})


def preview_frames(grids: DataFrame, keys, tile_size=TILE_SIZE, crs: str | None = None) -> DataFrame:
    """One frame per dataset showing all of it."""
    return _working_size(_own_box(grids, keys, crs), tile_size)


def reprojected_frames(grids: DataFrame, keys, crs: str | None = None) -> DataFrame:
    """One frame per dataset at its suggested Web Mercator resolution."""
    size = lambda hi, lo: F.greatest(F.floor((F.col(hi) - F.col(lo)) / F.col("res") + 0.5).cast("int"), F.lit(1))
    own = _own_box(grids, keys, crs).withColumns({"vw": size("mr", "ml"), "vh": size("mt", "mb")})
    # pixels keep the suggested resolution, so the last column and row may end past the box
    return own.withColumns({"right": F.col("left") + F.col("vw") * F.col("res"),
                            "bottom": F.col("top") - F.col("vh") * F.col("res")})


# --- step 1: source blocks to working pixels --------------------------------

def _chunks(frames: DataFrame, keys, ids) -> DataFrame:
    """Chunks of working pixels (inclusive c0..c1, r0..r1) that can touch the dataset."""
    sx = (F.col("right") - F.col("left")) / F.col("vw")
    sy = (F.col("top") - F.col("bottom")) / F.col("vh")
    clip = lambda c, n: F.greatest(F.lit(0), F.least(c.cast("int"), F.col(n) - 1))
    first_c = clip(F.floor((F.col("ml") - F.col("left")) / F.col("sx")) - 1, "vw")
    last_c = clip(F.floor((F.col("mr") - F.col("left")) / F.col("sx")) + 1, "vw")
    first_r = clip(F.floor((F.col("top") - F.col("mt")) / F.col("sy")) - 1, "vh")
    last_r = clip(F.floor((F.col("top") - F.col("mb")) / F.col("sy")) + 1, "vh")
    ranges = frames.withColumns({"sx": sx, "sy": sy}).withColumns(
        {"_fc": first_c, "_lc": last_c, "_fr": first_r, "_lr": last_r})
    cut = (
        ranges.withColumn("c0", F.explode(F.sequence("_fc", "_lc", F.lit(CHUNK))))
        .withColumn("r0", F.explode(F.sequence("_fr", "_lr", F.lit(CHUNK)))))
    masks = [F.col(c) if c in frames.columns else F.lit(None).cast(kind).alias(c) for c, kind in zip(MASKS, ("double", "boolean"))]
    return cut.select(*keys, *ids, *HEADER, *masks, "vw", "vh", F.col("left").alias("fl"), F.col("top").alias("ft"), "sx", "sy", "c0", "r0",
                      F.least(F.col("c0") + CHUNK - 1, F.col("_lc")).alias("c1"),
                      F.least(F.col("r0") + CHUNK - 1, F.col("_lr")).alias("r1"))


def _source_extent(chunks: DataFrame, crs: str) -> DataFrame:
    """Source pixels under each chunk, as a range of fractional columns u0..u1 and rows v0..v1.

    Where longitude depends on x and latitude on y alone, source positions are
    monotone along both axes and the four corners are the extremes. Otherwise
    the chunk's outline is sampled every dozen pixels; the image of the outline
    bounds the image of the chunk, and one pixel of slack covers its curvature.
    """
    outline = {"left": F.col("fl") + (F.col("c0") + 0.5) * F.col("sx"), "right": F.col("fl") + (F.col("c1") + 0.5) * F.col("sx"),
               "bottom": F.col("ft") - (F.col("r1") + 0.5) * F.col("sy"), "top": F.col("ft") - (F.col("r0") + 0.5) * F.col("sy")}
    if crs in geo.SEPARABLE:
        ends = [(outline["left"], outline["bottom"]), (outline["right"], outline["top"])]
        if crs == geo.WGS84:
            ends = [geo.separable_lonlat(geo.WEB_MERCATOR, *p) for p in ends]
        (x0, y0), (x1, y1) = ends
        boxed = geo.once(chunks, _x0=x0, _y0=y0, _x1=x1, _y1=y1)
        us, vs = zip(*[geo.xy_to_pixel(x, y) for x in ("_x0", "_x1") for y in ("_y0", "_y1")])
        return boxed.select(*chunks.columns, F.least(*us).alias("u0"), F.greatest(*us).alias("u1"),
                            F.least(*vs).alias("v0"), F.greatest(*vs).alias("v1"))
    placed = geo.mercator_to_pixel(box_edges(chunks.withColumns(outline)), crs, F.col("_x"), F.col("_y"), "_u", "_v")
    return placed.groupBy(*chunks.columns).agg(
        F.min("_u").alias("u0"), F.max("_u").alias("u1"), F.min("_v").alias("v0"), F.max("_v").alias("v1"))


def _chunk_blocks(chunks: DataFrame, crs: str, reach: int, size: int) -> DataFrame:
    """One row per chunk and source block under it."""
    slack = reach + 1
    block = lambda c, n, d: F.floor(
        F.greatest(F.lit(0.0), F.least(F.floor(c) + F.lit(d), (F.col(n) - 1).cast("double"))) / size).cast("int")
    near = (F.col("u1") >= -slack) & (F.col("v1") >= -slack) \
        & (F.col("u0") < F.col("width") + slack) & (F.col("v0") < F.col("height") + slack)
    return (
        _source_extent(chunks, crs).where(near)
        .withColumn("block_row", F.explode(F.sequence(block("v0", "height", -slack), block("v1", "height", slack))))
        .withColumn("block_col", F.explode(F.sequence(block("u0", "width", -slack), block("u1", "width", slack))))
        .select(*chunks.columns, "block_row", "block_col"))


def _layers(blocks: DataFrame) -> list[str]:
    return [c for c in ("values", "alpha") if c in blocks.columns]


def _read(blocks: DataFrame, at: Column) -> Column:
    """The pixel at a position of a block's array, masked by the rules of its grid."""
    alpha = F.get("alpha", at) if "alpha" in blocks.columns else None
    return read_mask(F.get("values", at), "nodata", alpha, F.coalesce("has_alpha", F.lit(False)))


def _linear(pixels: DataFrame, group: list[str], size: int) -> DataFrame:
    """Linear values of pixels (``_u``, ``_v``) in the block that holds the pixel left of and above them, out of its ``pad``."""
    base = lambda c: F.floor(F.col(c) - 0.5).cast("int")
    owner = lambda c: F.call_function("div", F.greatest(base(c), F.lit(0)), F.lit(size))
    mine = pixels.where((owner("_v") == F.col("block_row")) & (owner("_u") == F.col("block_col")))
    placed = geo.once(mine, _fc=F.col("_u") - 0.5 - base("_u"), _fr=F.col("_v") - 0.5 - base("_v"),
                      _at=(base("_v") - F.col("block_row") * size + 1) * (size + 2) + base("_u") - F.col("block_col") * size + 1)
    read = lambda r, c: F.coalesce(F.get("pad", F.col("_at") + (r * (size + 2) + c)), F.lit(float("nan")))
    tapped = geo.once(placed, **{f"_t{r}{c}": read(r, c) for r in (0, 1) for c in (0, 1)})
    near = [(F.col(f"_t{r}{c}"), linear_weight(F.col("_fr") - r) * linear_weight(F.col("_fc") - c)) for r in (0, 1) for c in (0, 1)]
    some = lambda terms: reduce(add, [F.when(F.isnan(v), 0.0).otherwise(x) for v, x in terms])
    summed = geo.once(tapped, _w=some(near), _wv=some([(v, w * v) for v, w in near]))
    return summed.select(*group, F.when(F.col("_w") > MIN_WEIGHT, F.col("_wv") / F.col("_w")).alias("v")).where("v IS NOT NULL")


def warp(blocks: DataFrame, frames: DataFrame, keys, ids, method: str = "linear",
         block_size: int = BLOCK_SIZE, crs: str | None = None) -> DataFrame:
    """Working pixels of every frame that have a value: keys, ids, vw, vh, vr, vc, v.

    A working pixel has a value only if its centre lies on the raster. Linear
    weighs the 4 pixels around it, leaving masked ones out; cubic weighs 16
    and falls back to linear where one of them is masked or off the raster. Masked are pixels of
    the grid's nodata value, pixels whose ``alpha`` (an array of the block) is 0 where the grid has alpha, and non-finite ones.

    For linear, blocks under the frames exchange margins, and each working pixel is made by one block. The 16 pixels of cubic are summed over
    the blocks that hold them: read from one row, they were slower (probably code too long for the JVM to compile well).
    """
    keys, ids = list(keys), list(ids)
    if crs is None:
        return per_crs(frames, lambda some, kind: warp(blocks, some, keys, ids, method, block_size, kind))
    check_method(method)
    if method == "average":
        raise ValueError("average reduces a working grid; warp with nearest, linear or cubic")
    reach = {"nearest": 0, "linear": 1, "cubic": 2}[method]
    taps = {"nearest": (0,), "cubic": (-1, 0, 1, 2)}.get(method)
    at, group = [*keys, "block_row", "block_col"], [*keys, *ids, "vw", "vh", "vr", "vc"]
    n_cols = F.col("c1") - F.col("c0") + 1
    n_pixels = n_cols * (F.col("r1") - F.col("r0") + 1)
    pairs = _chunk_blocks(_chunks(frames, keys, ids), crs, reach, block_size)
    # few small rows that are about to become many pixels: spread them by block, which is also how
    # the join wants them. A given number keeps AQE from putting the small rows back together.
    spread = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(spread, *at)
    read = blocks.select(*at, *_layers(blocks))
    if method == "linear":
        wanted = pairs.select(*at, "width", "height", *MASKS).distinct()
        alpha = F.col("alpha") if "alpha" in blocks.columns else None
        # spread like the pairs, which is how strips and blocks meet; once: eight strips and the block itself are made of it
        read = geo.once(read.join(wanted, at).repartition(spread, *at), _masked=masked_values(F.col("values"), block_size, alpha)).select(*at, F.col("_masked").alias("values"))
        read = with_halo(read, at, reach, block_size)
    pixels = (
        pairs.join(read, at)
        .withColumn("_i", F.explode(F.sequence(F.lit(0), n_pixels - 1)))
        .withColumn("vc", F.col("c0") + F.col("_i") % n_cols)
        .withColumn("vr", F.col("r0") + F.call_function("div", F.col("_i"), n_cols).cast("int")))
    x = F.col("fl") + (F.col("vc") + 0.5) * F.col("sx")
    y = F.col("ft") - (F.col("vr") + 0.5) * F.col("sy")
    pixels = geo.mercator_to_pixel(pixels, crs, x, y, "_u", "_v").where(
        (F.col("_u") >= 0) & (F.col("_u") < F.col("width")) & (F.col("_v") >= 0) & (F.col("_v") < F.col("height")))
    if method == "linear":
        return _linear(pixels, group, block_size)
    shift = 0.0 if method == "nearest" else 0.5
    base_c, base_r = F.floor(F.col("_u") - shift).cast("int"), F.floor(F.col("_v") - shift).cast("int")
    tapped = pixels.withColumns({"_bc": base_c, "_br": base_r})
    if len(taps) > 1:
        tapped = tapped.withColumn("_dc", F.explode(F.array(*[F.lit(t) for t in taps]))).withColumn(
            "_dr", F.explode(F.array(*[F.lit(t) for t in taps])))
    else:
        tapped = tapped.withColumns({"_dc": F.lit(0), "_dr": F.lit(0)})
    in_col = F.col("_bc") + F.col("_dc") - F.col("block_col") * block_size
    in_row = F.col("_br") + F.col("_dr") - F.col("block_row") * block_size
    tapped = tapped.withColumns({"_ic": in_col, "_ir": in_row}).where(
        F.col("_ic").between(0, block_size - 1) & F.col("_ir").between(0, block_size - 1)
        & (F.col("_bc") + F.col("_dc") < F.col("width")) & (F.col("_br") + F.col("_dr") < F.col("height")))
    read = _read(blocks, F.col("_ir") * block_size + F.col("_ic"))
    tapped = tapped.withColumn("_val", read).where("_val IS NOT NULL")
    if method == "nearest":
        # one tap, held by one block
        return tapped.select(*group, F.col("_val").alias("v"))
    du = F.col("_u") - 0.5 - F.col("_bc") - F.col("_dc")
    dv = F.col("_v") - 0.5 - F.col("_br") - F.col("_dr")
    wl = linear_weight(du) * linear_weight(dv)
    summed = tapped.groupBy(*group).agg(
        F.sum(wl).alias("_w"), F.sum(wl * F.col("_val")).alias("_wv"),
        F.sum(cubic_weight(du) * cubic_weight(dv) * F.col("_val")).alias("_cv"), F.count("*").alias("_n"))
    out = F.when(F.col("_n") == 16, F.col("_cv")).when(F.col("_w") > MIN_WEIGHT, F.col("_wv") / F.col("_w"))
    return summed.select(*group, out.alias("v")).where("v IS NOT NULL")


# --- step 2: working pixels to frame pixels ---------------------------------

def _spread(c: Column, ratio: Column, n: int, method: str) -> Column:
    """Frame positions a working position contributes to along one axis."""
    lo, hi = c / ratio, (c + 1) / ratio
    if method == "average":
        first, last = F.floor(lo), F.ceil(hi) - 1
    else:
        radius = {"nearest": 0.5, "linear": 1.0, "cubic": 2.0}[method]
        mid = (c + 0.5) / ratio - 0.5
        first, last = F.ceil(mid - radius), F.floor(mid + radius)
        # the position whose nearest pixel this is must be among them
        first, last = F.least(first, F.floor(lo)), F.greatest(last, F.floor(lo))
    clip = lambda p: F.greatest(F.lit(0), F.least(p.cast("int"), F.lit(n - 1)))
    return F.sequence(clip(first), clip(last))


def _weight(t: Column, c: Column, ratio: Column, method: str) -> Column:
    if method == "average":
        return F.greatest(F.lit(0.0), F.least((c + 1) / ratio, t + 1.0) - F.greatest(c / ratio, t.cast("double")))
    if method == "nearest":
        return F.when(_nearest(t, ratio) == c, F.lit(1.0)).otherwise(F.lit(0.0))
    d = (c + 0.5) / ratio - (t + 0.5)
    return linear_weight(d) if method == "linear" else cubic_weight(d)


def _nearest(t: Column, ratio: Column) -> Column:
    return F.floor((t + 0.5) * ratio).cast("int")


def reduce_frames(working: DataFrame, keys, ids, tile_size, method: str = "average") -> DataFrame:
    """Frame pixels with a value: keys, ids, py, px, value.

    The mask is read by nearest neighbour whatever the method: a frame pixel
    is masked when the working pixel nearest to it is.
    """
    keys, ids = list(keys), list(ids)
    check_method(method)
    th, tw = (int(v) for v in tile_size)
    spread = (
        working.withColumns({"_rx": F.col("vw") / F.lit(tw), "_ry": F.col("vh") / F.lit(th)})
        .withColumn("px", F.explode(_spread(F.col("vc"), F.col("_rx"), tw, method)))
        .withColumn("py", F.explode(_spread(F.col("vr"), F.col("_ry"), th, method))))
    near = (_nearest(F.col("px"), F.col("_rx")) == F.col("vc")) & (_nearest(F.col("py"), F.col("_ry")) == F.col("vr"))
    if method == "nearest":
        # every frame pixel reads one working pixel: nothing to combine
        return spread.where(near).select(*keys, *ids, "py", "px", F.col("v").alias("value"))
    w = _weight(F.col("px"), F.col("vc"), F.col("_rx"), method) * _weight(F.col("py"), F.col("vr"), F.col("_ry"), method)
    summed = spread.withColumns({"_pw": w, "_near": near}).groupBy(*keys, *ids, "py", "px").agg(
        F.sum("_pw").alias("_w"), F.sum(F.col("_pw") * F.col("v")).alias("_wv"), F.max("_near").alias("_near"))
    return summed.where(F.col("_near") & (F.abs("_w") > MIN_WEIGHT)).select(
        *keys, *ids, "py", "px", (F.col("_wv") / F.col("_w")).alias("value"))


# --- layers -----------------------------------------------------------------

TILE_IDS = ("z", "x", "y")


def frame_pixels(blocks: DataFrame, frames: DataFrame, keys, ids, tile_size, crs: str, reprojection: str = "linear",
                 resampling: str = "average", preserve_values: bool = False,
                 block_size: int = BLOCK_SIZE) -> DataFrame:
    """Both steps for the frames of one CRS kind. ``preserve_values`` (categorical data) uses nearest in both.

    Frames finer than their source need no second step. Whether there are
    such frames, and others, is looked up in the frame table first, so that
    only the needed plan is built and no pixel is computed twice.
    """
    if preserve_values:
        reprojection = resampling = "nearest"
    check_method(resampling)
    parts = []
    for fine in sorted(r[0] for r in frames.select("fine").distinct().collect()):  # at most two rows
        working = warp(blocks, frames.where(F.col("fine") == fine), keys, ids, reprojection, block_size, crs)
        parts.append(
            working.select(*keys, *ids, F.col("vr").alias("py"), F.col("vc").alias("px"), F.col("v").alias("value"))
            if fine else reduce_frames(working, keys, ids, tile_size, resampling))
    if not parts:
        parts = [reduce_frames(warp(blocks, frames, keys, ids, "nearest", block_size, crs), keys, ids, tile_size, "nearest")]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def tile_layer(blocks: DataFrame, grids: DataFrame, keys, zooms: Sequence[int], tile_size=TILE_SIZE,
               tiles: DataFrame | None = None, crs: str | None = None, min_cover: float = 0.0, **methods) -> DataFrame:
    """Pixels of all tiles of all datasets: keys, z, x, y, py, px, value."""
    def build(some, kind):
        frames = tile_frames(some, keys, zooms, tile_size, kind, tiles, min_cover)
        return frame_pixels(blocks, frames, keys, TILE_IDS, tile_size, kind, **methods)

    return per_crs(grids, build, crs)


def previews(blocks: DataFrame, grids: DataFrame, keys, tile_size=TILE_SIZE, crs: str | None = None, **methods) -> DataFrame:
    """Whole datasets, one image each: keys, py, px, value."""
    return per_crs(grids, lambda some, kind: frame_pixels(
        blocks, preview_frames(some, keys, tile_size, kind), keys, (), tile_size, kind, **methods), crs)


def reproject(blocks: DataFrame, grids: DataFrame, keys, method: str = "linear",
              block_size: int = BLOCK_SIZE, crs: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Every raster in Web Mercator at its suggested resolution: cells and grids."""
    cells = per_crs(grids, lambda some, kind: warp(
        blocks, reprojected_frames(some, keys, kind), keys, (), method, block_size, kind), crs)
    frames = reprojected_frames(grids, keys, crs)
    header = {"a": F.col("res"), "b": F.lit(0.0), "c": F.col("left"), "d": F.lit(0.0),
              "e": -F.col("res"), "f": F.col("top"), "width": F.col("vw"), "height": F.col("vh"),
              "crs": F.lit(geo.WEB_MERCATOR)}
    out = frames.withColumns(header).select(*grids.columns)
    return cells.select(*keys, F.col("vr").alias("row"), F.col("vc").alias("col"), F.col("v").alias("value")), out


def complete_tiles(wanted: DataFrame, pixels: DataFrame, keys, tile_size=TILE_SIZE, value: str = "value",
                   fill=0) -> DataFrame:
    """Every pixel of every wanted tile; pixels without a value, and tiles out of bounds, get ``fill``."""
    th, tw = (int(v) for v in tile_size)
    on = [*keys, *TILE_IDS, "py", "px"]
    grid = (wanted.select(*keys, *TILE_IDS).distinct()
            .withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(th - 1))))
            .withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(tw - 1)))))
    return grid.join(pixels.select(*on, value), on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def complete_images(images: DataFrame, rendered: DataFrame, tile_size=TILE_SIZE) -> DataFrame:
    """Every pixel of every image (rows of keys and, for tiles, z, x, y): those that were not rendered are transparent black."""
    th, tw = (int(v) for v in tile_size)
    on = [*images.columns, "py", "px"]
    grid = (images.withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(th - 1))))
            .withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(tw - 1)))))
    colors = [c for c in rendered.columns if c not in on]
    return grid.join(rendered, on, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in colors})
