"""Statistics of stored blocks: one state per block, merged up a quadtree, and exact percentiles from one more scan.

A block row becomes a state of a few kilobytes in one vectorised pass: count, extremes, mean, squared deviations, the ends of each raster
row (for hulls) and a digest of its values. States of 16 x 16 blocks merge into one, then 16 x 16 of those, so no task ever holds
more than 256 states of a dataset, however large that is.

A digest is a list of centroids (value, weight), each standing for an equal share of the pixels. Until a dataset has more than
``DIGEST`` different values its digest is exact, and percentiles are read from it. For other datasets the digest brackets each percentile,
and one scan counts what lies below each bracket and keeps only what lies inside. Counts at the ends of all brackets are exact then, so a
percentile that missed its bracket is known to lie between two neighbouring ends, and one further scan settles it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastertable.operators.percentiles import NODE_PIXELS, PERCENTS, _bucket, _size_checked
from rastertable.sources.cells import BLOCK_SIZE
from rastertable.sources.shared import checkpointed

DIGEST = 2000            # centroids of a digest at most
FAN = 16                 # blocks (or merged states) along a side that merge into one
BROADCAST_DATASETS = 5_000   # datasets whose brackets (3 KB each) are broadcast
HISTOGRAM = 4096

_POSITION = ("block_row", "block_col")
_STATE = [T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("min", "max", "mean", "m2")),
          T.StructField("centers", T.ArrayType(T.DoubleType())), T.StructField("weights", T.ArrayType(T.LongType())), T.StructField("exact", T.BooleanType())]
_ENDS = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("first_col", "last_col")]


# --- digests ------------------------------------------------------------------

def digest_of(values: np.ndarray, weights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Centroids of weighted values, whether each of them is one value. Up to ``most`` different values stay as they are;
    more are put together by rank, an equal share of the total weight in each centroid."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    if not len(values):
        return values, weights.astype(np.int64), True
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    centers, summed = values[starts], np.add.reduceat(weights, starts)
    if len(centers) <= most:
        return centers, summed, True
    middle = (np.cumsum(summed) - summed / 2) / summed.sum()
    share = np.minimum((middle * most).astype(np.int64), most - 1)
    heavy = summed * most >= summed.sum()  # a value that fills a share stays alone
    starts = np.flatnonzero(np.concatenate([[True], (share[1:] != share[:-1]) | heavy[1:] | heavy[:-1]]))
    total = np.add.reduceat(summed, starts)
    # weights first: a product of a large value and a large weight may leave the range
    part = summed / np.repeat(total, np.diff(np.append(starts, len(summed))))
    return np.add.reduceat(centers * part, starts), total, False


# --- states -------------------------------------------------------------------

def _pixels(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray | None]:
    column = batch.column(batch.schema.get_field_index(name))
    flat, at, present = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), np.asarray(column.is_valid())
    for a, b, there in zip(at[:-1], at[1:], present, strict=True):
        yield flat[a:b] if there else None


def _valid(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pixels of each block, and which of them count: finite, not the grid's nodata value, alpha not 0 where the grid has alpha."""
    at = batch.schema.get_field_index
    nodata, has_alpha = batch.column(at("_nodata")).to_pylist(), batch.column(at("_has_alpha")).to_pylist()
    alphas = _pixels(batch, "alpha") if at("alpha") >= 0 else iter([None] * batch.num_rows)
    for v, none, has, alpha in zip(_pixels(batch, "values"), nodata, has_alpha, alphas, strict=True):
        v = np.zeros(0) if v is None else np.asarray(v, np.float64)
        good = np.isfinite(v)
        if none is not None:
            good &= v != none
        if has:
            good &= np.nan_to_num(np.asarray(alpha, np.float64)) != 0 if alpha is not None else False
        yield v, good


def with_masks(blocks: DataFrame, grids: DataFrame, keys) -> DataFrame:
    """Blocks with the nodata value of their grid (``_nodata``) and whether it has alpha (``_has_alpha``)."""
    has = lambda c: c in grids.columns
    rules = grids.select(*keys, (F.col("nodata") if has("nodata") else F.lit(None)).cast("double").alias("_nodata"),
                         (F.coalesce("has_alpha", F.lit(False)) if has("has_alpha") and "alpha" in blocks.columns else F.lit(False)).alias("_has_alpha"))
    return blocks.join(_size_checked(checkpointed(rules)), list(keys))


def _row_ends(good: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last counted column of each pixel row of a block, -1 where there is none."""
    square = good.reshape(-1, size)
    some = square.any(1)
    return np.where(some, square.argmax(1), -1), np.where(some, size - 1 - square[:, ::-1].argmax(1), -1)


def states_of_blocks(blocks: DataFrame, grids: DataFrame, keys, size: int = BLOCK_SIZE, digest: int = DIGEST) -> DataFrame:
    """One state per stored block, wholly masked ones with n = 0: keys, block_row, block_col, n, min, max, mean, m2,
    ``centers`` and ``weights`` and ``exact`` (the digest), ``first_col`` and ``last_col`` by pixel row."""
    keys = list(keys)
    own = [c for c in (*keys, *_POSITION, "values", "alpha") if c in blocks.columns]
    blocks = with_masks(blocks.select(own), grids, keys)
    head = [*keys, *_POSITION]
    schema = T.StructType([blocks.schema[c] for c in head] + _STATE + _ENDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v, good in _valid(batch):
                v = v[good]
                mean = float(v.mean()) if len(v) else None
                centers, weights, exact = digest_of(v, np.ones(len(v), np.int64), digest)
                lo, hi = _row_ends(good, size)
                rows.append((len(v), *((float(v.min()), float(v.max()), mean, float(((v - mean) ** 2).sum())) if len(v) else (None,) * 4),
                             centers, weights, exact, lo, hi))
            yield _table(batch, head, rows, schema)

    return blocks.mapInArrow(run, schema)


def _table(batch: pa.RecordBatch, head: list[str], rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    columns = [batch.column(batch.schema.get_field_index(c)) for c in head]
    columns += [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * (len(target) - len(head)), list(target)[len(head):], strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=target)


def merged_states(states: DataFrame, keys, digest: int = DIGEST) -> DataFrame:
    """One state per dataset (without row ends): FAN x FAN neighbours merge, level by level. Datasets without a counted pixel have none."""
    keys = list(keys)
    now = states.where("n > 0").select(*keys, *_POSITION, *(f.name for f in _STATE))
    reach = now.agg(F.greatest(F.max("block_row"), F.max("block_col"))).first()[0] or 0  # one number for all datasets
    schema = T.StructType([now.schema[c] for c in (*keys, *_POSITION)] + _STATE)

    def merge(group: pa.Table) -> pa.Table:
        n, mean = group["n"].to_numpy(), group["mean"].to_numpy()
        total = int(n.sum())
        middle = float((mean * (n / total)).sum())
        flat = lambda c: np.concatenate([np.asarray(x) for x in group[c].to_numpy(zero_copy_only=False)])
        centers, weights, exact = digest_of(flat("centers"), flat("weights"), digest)
        row = {"n": total, "min": group["min"].to_numpy().min(), "max": group["max"].to_numpy().max(), "mean": middle,
               "m2": float((group["m2"].to_numpy() + n * (mean - middle) ** 2).sum()), "centers": centers, "weights": weights,
               "exact": exact and all(group["exact"].to_pylist())}
        head = [group[c].slice(0, 1).combine_chunks() for c in (*keys, *_POSITION)]
        from pyspark.sql.pandas.types import to_arrow_schema
        target = to_arrow_schema(schema)
        return pa.table([*head, *(pa.array([row[f.name]], f.type) for f in list(target)[len(head):])], schema=target)

    while True:
        up = now.withColumns({c: F.floor(F.col(c) / FAN).cast("int") for c in _POSITION})
        now = up.groupBy(*keys, *_POSITION).applyInArrow(merge, schema)
        reach //= FAN
        if not reach:
            return now.drop(*_POSITION)


def moments_of(merged: DataFrame, keys) -> DataFrame:
    return merged.select(*keys, F.col("n").alias("n_valid"), "min", "max", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("stdev"))


def digest_percentiles(merged: DataFrame, keys) -> DataFrame:
    """Percentiles 1..99 from the digests alone: what the centroids that hold the ranks stand for, so at most a centroid's share of the pixels away."""
    return _listed(_read(merged, list(keys)), list(keys))


def row_ends(states: DataFrame, keys, size: int = BLOCK_SIZE) -> DataFrame:
    """First and last counted column (``lo``, ``hi``) of each raster row."""
    some = states.where("n > 0").select(*keys, *_POSITION, F.posexplode(F.arrays_zip("first_col", "last_col")).alias("_i", "_e")).where("_e.first_col >= 0")
    left = F.col("block_col") * size
    return some.groupBy(*keys, (F.col("block_row") * size + F.col("_i")).alias("row")).agg(
        F.min(left + F.col("_e.first_col")).cast("int").alias("lo"), F.max(left + F.col("_e.last_col")).cast("int").alias("hi"))


# --- exact percentiles ----------------------------------------------------------

def _ranks(total: Column, p: Column) -> tuple[Column, Column, Column]:
    """Ranks below and above percentile p of ``total`` values, and the weight of the upper one."""
    at = (total - 1) * p
    lower = F.call_function("div", at, F.lit(100).cast("long"))
    return lower, F.when(at % 100 == 0, lower).otherwise(lower + 1), (at % 100).cast("double") / 100


def _brackets(merged: DataFrame, keys) -> DataFrame:
    """keys, ``p``, ``lo``, ``hi`` and ``total``: values that the digest expects around the ranks of each percentile, two centroids to either side."""
    head = list(keys)
    schema = T.StructType([merged.schema[c] for c in head] + [T.StructField("total", T.LongType()), *(
        T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("los", "his"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ends = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n", "min", "max")]
            for c, w, n, low, high in zip(_pixels(batch, "centers"), _pixels(batch, "weights"), *ends, strict=True):
                at = (n - 1) * np.asarray(PERCENTS, np.int64)
                lower = at // 100
                upper = lower + (at % 100 > 0)
                cum = np.cumsum(w)
                a, b = np.searchsorted(cum, lower, side="right") - 2, np.searchsorted(cum, upper, side="right") + 2
                rows.append((n, np.where(a >= 0, c[np.maximum(a, 0)], low), np.where(b < len(c), c[np.minimum(b, len(c) - 1)], high)))
            yield _table(batch, head, rows, schema)

    each = merged.select(*head, "n", "min", "max", "centers", "weights").mapInArrow(run, schema)
    return each.select(*head, "total", F.posexplode(F.arrays_zip("los", "his")).alias("_i", "_b")).select(
        *head, "total", (F.col("_i") + 1).alias("p"), F.col("_b.los").alias("lo"), F.col("_b.his").alias("hi"))


def _scan(blocks: DataFrame, brackets: DataFrame, keys) -> DataFrame:
    """Read all pixels of the datasets that have brackets: rows with ``p``, the numbers of values below ``lo``, inside, and below ``hi`` (``below``, ``n``, ``under``);
    and rows with ``v`` (p null), each value inside any bracket once, however many brackets it lies in, with its number ``n``."""
    keys = list(keys)
    wanted = checkpointed(brackets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p", "lo", "hi"))).alias("_wanted")))  # 99 at most
    joined = blocks.join(_few(wanted), keys)
    counts = ("below", "n", "under")
    schema = T.StructType([blocks.schema[c] for c in keys] + [T.StructField("p", T.IntegerType()), T.StructField("v", T.DoubleType()), *(T.StructField(c, T.LongType()) for c in counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        target = to_arrow_schema(schema)
        for batch in batches:
            wanted = batch.column(batch.schema.get_field_index("_wanted"))
            for i, (v, good) in enumerate(_valid(batch)):
                values, counts = np.unique(v[good], return_counts=True)
                own = wanted[i].values
                p, lo, hi = (own.field(k).to_numpy() for k in range(3))
                cum = np.concatenate([[0], np.cumsum(counts)])
                a, b, c = np.searchsorted(values, lo, side="left"), np.searchsorted(values, hi, side="right"), np.searchsorted(values, hi, side="left")
                steps = np.zeros(len(values) + 1, np.int64)
                np.add.at(steps, a, 1)
                np.add.at(steps, np.maximum(a, b), -1)
                inside = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
                none, rows = np.zeros(len(inside), np.int64), len(p) + len(inside)
                of_value = np.arange(rows) >= len(p)
                numbers = ((cum[a], none), (np.maximum(cum[b] - cum[a], 0), counts[inside]), (cum[c], none))
                head = [pa.repeat(batch.column(batch.schema.get_field_index(k))[i], rows) for k in keys]
                yield pa.RecordBatch.from_arrays([*head, pa.array(np.concatenate([p, none]).astype(np.int32), mask=of_value),
                                                  pa.array(np.concatenate([np.zeros(len(p)), values[inside]]), mask=~of_value),
                                                  *(pa.array(np.concatenate(x).astype(np.int64)) for x in numbers)], schema=target)

    return joined.mapInArrow(run, schema).groupBy(*keys, "p", "v").agg(*(F.sum(c).alias(c) for c in counts))


def _few(per_dataset: DataFrame) -> DataFrame:
    """Broadcast hint behind a count of datasets (checkpointed, a row of at most 99 brackets each)."""
    return F.broadcast(per_dataset) if per_dataset.limit(BROADCAST_DATASETS + 1).count() <= BROADCAST_DATASETS else per_dataset


def _placed(scanned: DataFrame, brackets: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """Brackets with ``start`` (rank of the first value inside), ``inside`` (their number), ``under`` (the number below ``hi``) and whether both ranks were ``hit``; values inside any."""
    scanned = checkpointed(scanned)
    sums = scanned.where("p IS NOT NULL").select(*keys, "p", F.col("below").alias("start"), F.col("n").alias("inside"), "under")
    lower, upper, _ = _ranks(F.col("total"), F.col("p"))
    hit = (F.col("start") <= lower) & (upper < F.col("start") + F.col("inside"))
    return checkpointed(brackets.join(sums, [*keys, "p"]).withColumn("hit", hit)), scanned.where("p IS NULL").select(*keys, "v", "n")


def _narrowed(placed: DataFrame, keys) -> DataFrame:
    """Hit brackets cut down to the nearest of all known ends around their ranks, so that overlapping ones share little: one row per dataset with ``_own``, an
    array of p, total, start, size, lo and hi."""
    ends = placed.groupBy(*keys).agg(F.flatten(F.collect_list(F.array(
        F.struct(F.col("lo").alias("x"), F.col("start").alias("below"), F.lit(None).cast("long").alias("upto")),
        F.struct(F.col("hi").alias("x"), F.col("under").alias("below"), (F.col("start") + F.col("inside")).alias("upto"))))).alias("_ends"))
    lower, upper, _ = _ranks(F.col("total"), F.col("p"))
    low = F.array_max(F.transform(F.filter("_ends", lambda e: e["below"] <= lower), lambda e: F.struct(e["x"], e["below"])))
    high = F.array_min(F.transform(F.filter("_ends", lambda e: e["upto"] > upper), lambda e: F.struct(e["x"], e["upto"])))
    each = placed.where("hit").join(ends, list(keys)).select(*keys, "p", "total", low.alias("_low"), high.alias("_high"))
    own = F.struct("p", "total", F.col("_low.below").alias("start"), (F.col("_high.upto") - F.col("_low.below")).alias("size"),
                   F.col("_low.x").alias("lo"), F.col("_high.x").alias("hi"))
    return each.groupBy(*keys).agg(F.collect_list(own).alias("_own"))


def _gaps(placed: DataFrame, merged: DataFrame, keys) -> DataFrame:
    """New brackets for percentiles that missed theirs: between neighbouring ends, whose ranks are known exactly, so these cannot miss."""
    ends = placed.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi", "start", (F.col("start") + F.col("inside")).alias("stop"))).alias("_ends"))
    lower, upper, _ = _ranks(F.col("total"), F.col("p"))
    missed = placed.where("NOT hit").select(*keys, "total", "p").join(ends, list(keys)).join(merged.select(*keys, "min", "max"), list(keys))
    pick = lambda test, end: F.transform(F.filter("_ends", test), lambda e: e[end])
    low = F.array_max(F.concat(F.array("min"), pick(lambda e: e["start"] <= lower, "lo"), pick(lambda e: e["stop"] <= lower, "hi")))
    high = F.array_min(F.concat(F.array("max"), pick(lambda e: e["start"] > upper, "lo"), pick(lambda e: e["stop"] > upper, "hi")))
    return missed.select(*keys, "total", "p", low.alias("lo"), high.alias("hi"))


def _selected(values: DataFrame, placed: DataFrame, keys, node: int) -> DataFrame:
    """Interpolated percentile for each hit bracket: keys, p, q. Brackets of many values are halved into buckets until few are left around the ranks."""
    on = [*keys, "p"]
    lower, upper, weight = _ranks(F.col("total"), F.col("p"))
    own = F.filter("_own", lambda b: F.col("v").between(b["lo"], b["hi"]))
    rows = values.join(_few(checkpointed(_narrowed(placed, keys))), list(keys)).select(*keys, "v", "n", F.explode(own).alias("_b")).select(*keys, "v", "n", "_b.*")
    while not rows.where((F.col("size") > node) & (F.col("lo") < F.col("hi"))).isEmpty():
        rows = rows.withColumn("_b", _bucket(F.col("v"), F.col("lo"), F.col("hi"), HISTOGRAM))
        hist = rows.groupBy(*on, "_b", "total", "start").agg(F.sum("n").alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        hist = hist.withColumn("start", F.col("start") + F.sum("size").over(Window.partitionBy(*on).orderBy("_b")) - F.col("size"))
        hist = hist.where((F.col("start") <= upper) & (F.col("start") + F.col("size") > lower))
        # the two ranks may lie in two buckets: both stay one bracket, so the lower start counts for both
        span = hist.groupBy(*on).agg(F.min("start").alias("start"), F.sum("size").alias("size"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("total").alias("total"))
        rows = checkpointed(rows.select(*on, "v", "n").join(_size_checked(checkpointed(span)), on).where("v BETWEEN lo AND hi"))
    first = F.col("start") + F.sum("n").over(Window.partitionBy(*on).orderBy("v")) - F.col("n")
    ranked = rows.withColumn("_first", first)
    holds = lambda rank: (rank >= F.col("_first")) & (rank < F.col("_first") + F.col("n"))
    return (ranked.where(holds(lower) | holds(upper)).groupBy(*on).agg(
        F.max(weight).alias("_w"), F.max(F.when(holds(lower), F.col("v"))).alias("_a"), F.max(F.when(holds(upper), F.col("v"))).alias("_z"))
        .select(*on, ((1 - F.col("_w")) * F.col("_a") + F.col("_w") * F.col("_z")).alias("q")))


def _read(merged: DataFrame, keys) -> DataFrame:
    """Percentiles of digests, exact where they hold every value: keys, p, q."""
    each = merged.select(*keys, F.col("n").alias("total"), F.explode(F.array(*[F.lit(p) for p in PERCENTS])).alias("p"), "centers", "weights")
    lower, upper, weight = _ranks(F.col("total"), F.col("p"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("z"))
    step = lambda s, c: F.struct(
        (s["seen"] + c["w"]).alias("seen"), F.coalesce(s["a"], F.when(s["seen"] + c["w"] > lower, c["c"])).alias("a"),
        F.coalesce(s["z"], F.when(s["seen"] + c["w"] > upper, c["c"])).alias("z"))
    found = F.aggregate(F.arrays_zip(F.col("centers").alias("c"), F.col("weights").alias("w")), start, step)
    return each.select(*keys, "p", weight.alias("_w"), found.alias("_f")).select(
        *keys, "p", ((1 - F.col("_w")) * F.col("_f.a") + F.col("_w") * F.col("_f.z")).alias("q"))


def exact_percentiles_of_blocks(blocks: DataFrame, grids: DataFrame, keys, merged: DataFrame, node: int = NODE_PIXELS) -> DataFrame:
    """One row per dataset of ``merged`` (checkpointed): keys, ``percentiles``. Exact digests are read; pixels of all other datasets are scanned once more, those of
    percentiles that missed their bracket a last time."""
    keys = list(keys)
    parts = [_read(merged.where("exact"), keys)]
    rough = merged.where("NOT exact")
    if not rough.isEmpty():
        own = [c for c in (*keys, "values", "alpha") if c in blocks.columns]
        masked = with_masks(blocks.select(own), grids, keys)
        placed, values = _placed(_scan(masked, brackets := checkpointed(_brackets(rough, keys)), keys), brackets, keys)
        parts.append(_selected(values, placed, keys, node))
        if not placed.where("NOT hit").isEmpty():
            again = checkpointed(_gaps(placed, rough, keys))
            placed, values = _placed(_scan(masked, again, keys), again, keys)
            parts.append(_selected(values, placed, keys, node))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return _listed(every, keys)


def _listed(each: DataFrame, keys) -> DataFrame:
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "q"))), lambda s: s["q"]).alias("percentiles"))


# --- whole metadata ---------------------------------------------------------------

def metadata_of_blocks(blocks: DataFrame, grids: DataFrame, keys, *, percentiles: str = "exact", size: int = BLOCK_SIZE,
                       digest: int = DIGEST, extra: DataFrame | None = None) -> DataFrame:
    """The rows of ``compute_metadata`` from stored blocks (keys, block_row, block_col, values, optionally alpha).

    One scan makes the states, from which all but exact percentiles of datasets with many different values follows; those take one more scan,
    rarely two. ``percentiles`` is ``exact`` or ``approx`` (from the digests alone).
    """
    keys = list(keys)
    if percentiles not in ("exact", "approx"):
        raise ValueError(f"unknown percentile method {percentiles!r}")
    states = checkpointed(states_of_blocks(blocks, grids, keys, size, digest))
    merged = checkpointed(merged_states(states, keys, digest))
    ranks = exact_percentiles_of_blocks(blocks, grids, keys, merged) if percentiles == "exact" else digest_percentiles(merged, keys)
    return _metadata(states, merged, ranks, grids, keys, size, extra)


def metadata_of_states(states: DataFrame, grids: DataFrame, keys, size: int = BLOCK_SIZE, digest: int = DIGEST, extra: DataFrame | None = None) -> DataFrame:
    """The same from states alone (checkpointed), without any pixel: percentiles are those of the digests."""
    keys = list(keys)
    merged = checkpointed(merged_states(states, keys, digest))
    return _metadata(states, merged, digest_percentiles(merged, keys), grids, keys, size, extra)


def _metadata(states: DataFrame, merged: DataFrame, ranks: DataFrame, grids: DataFrame, keys, size: int, extra: DataFrame | None) -> DataFrame:
    from rastertable.operators import hull as hulls
    from rastertable.operators.stats import geographic_bounds

    total = (F.col("width").cast("long") * F.col("height")).cast("double")
    hull = hulls.convex_hull_of_rows(row_ends(states, keys, size), grids, keys)
    out = (moments_of(merged, keys).join(grids.select(*keys, total.alias("_total")), keys).withColumn("valid_percentage", F.col("n_valid") / F.col("_total") * 100)
           .join(ranks, keys).join(geographic_bounds(grids, keys), keys).join(hull, keys))
    if extra is not None:
        out = out.join(extra.select(*keys, "metadata"), keys, "left")
    else:
        out = out.withColumn("metadata", F.lit(None).cast("string"))
    return out.select(
        *keys, "west", "south", "east", "north", "convex_hull", "valid_percentage", "min", "max", "mean", "stdev",
        F.col("percentiles").cast("array<float>").alias("percentiles"), F.coalesce("metadata", F.lit("{}")).alias("metadata"))
