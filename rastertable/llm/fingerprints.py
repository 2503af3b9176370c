"""Document fingerprints by randomised edit embedding.

All texts share random functions r_j from characters to {0, 1}. A walk reads a text: at step j it writes the character
that it stands on and moves on if r_j of that character is 1. Walks over texts with a small edit distance soon meet again after an edit
and then write the same symbols at the same steps, so the Hamming distance of what they write follows the edit distance. A
fingerprint samples the written symbols, 32 steps of each octave, each as four bits of a hash of what is read next.
Near documents are found by banding samples of these bits and verified on whole fingerprints, every two of a bucket that nothing else ties.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertable.llm.graph import components
from rastertable.llm.tables import checkpointed, documents, map_rows

CLASSES, PERIOD, SAMPLES = 256, 1024, 32
#: Walks of similar length advance together if there are so many of them, else one by one.
TOGETHER, CELLS, SLICE_CHARS = 80, 6 << 20, 12 << 20
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _steps() -> np.ndarray:
    """How many steps a walk stays on a character of a class when it comes there at step j (mod PERIOD)."""
    moves = np.random.default_rng(20240501).integers(0, 2, (CLASSES, PERIOD)).astype(bool)
    at = np.arange(2 * PERIOD)
    twice = np.concatenate([moves, moves], 1)
    following = np.where(twice, at, 4 * PERIOD)
    following = np.minimum.accumulate(following[:, ::-1], 1)[:, ::-1]
    return (following - at)[:, :PERIOD].astype(np.int64) + 1


STEPS = _steps()
_FLAT, _LISTS = STEPS.ravel(), STEPS.tolist()


def sampled(length: int) -> np.ndarray:
    """Steps below ``length`` that are sampled: all of the first octaves, then 32 in each."""
    out = [np.arange(SAMPLES)]
    at = SAMPLES
    while at < length:
        out.append(at + np.arange(SAMPLES) * (at // SAMPLES))
        at *= 2
    steps = np.concatenate(out)
    return steps[steps < length]


def weights(n: int) -> np.ndarray:
    """How many steps each of the first ``n`` samples stands for."""
    return 2.0 ** np.maximum(0, np.arange(n) // SAMPLES - 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _walk(lanes: list[np.ndarray]) -> list[tuple[np.ndarray, int]]:
    """For each text (classes of its characters): the step at which the walk comes to each character, and the steps in all."""
    if len(lanes) < TOGETHER:
        out = []
        for own in lanes:
            j, at = 0, []
            add = at.append
            for c in own.tolist():
                add(j)
                j += _LISTS[c][j & (PERIOD - 1)]
            out.append((np.array(at, np.int64), j))
        return out
    most = max(map(len, lanes))
    rows = np.zeros((len(lanes), most), np.uint8)
    for row, own in zip(rows, lanes, strict=True):
        row[:len(own)] = own
    base = np.ascontiguousarray(rows.T).astype(np.int32) * PERIOD
    at = np.empty((most + 1, len(lanes)), np.int32)
    j = np.zeros(len(lanes), np.int32)
    small = _FLAT.astype(np.int32)
    for i in range(most):
        at[i] = j
        j = j + small[base[i] + (j & (PERIOD - 1))]
    at[most] = j
    at = np.ascontiguousarray(at.T)
    return [(own[:len(lane)].astype(np.int64), int(own[len(lane)])) for own, lane in zip(at, lanes, strict=True)]


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """Samples (0 to 15) of each text; none of an empty text."""
    points = [code_points(t) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(points[i]))
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(texts)
    start = 0
    while start < len(order):
        longest, stop = len(points[order[start]]), start + 1
        while stop < len(order) and len(points[order[stop]]) >= 0.75 * longest and (stop - start) * longest < CELLS:
            stop += 1
        group = order[start:stop]
        if longest:
            classes = [((points[i] * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8) for i in group]
            for i, (at, steps) in zip(group, _walk(classes), strict=True):
                out[i] = _samples(points[i], at, steps)
        start = stop
    return out


def _samples(points: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
    take = sampled(steps)
    where = np.searchsorted(at, take, "right") - 1
    padded = np.concatenate([points, np.zeros(3, np.uint32)])
    # where the walk stands and since when fixes what it writes next
    h = (take - at[where]).astype(np.uint32)
    for k in range(4):
        h = (h ^ padded[where + k]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    return (h * np.uint32(0xC2B2AE35) >> np.uint32(28)).astype(np.uint8)


def text_of(samples: np.ndarray) -> str:
    return _HEX[samples].tobytes().decode()


def samples_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.where(raw >= 97, raw - 87, raw - 48).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of steps at which two walks write the same, 0 to 1, less what chance gives; 1 for two empty texts."""
    n, most = min(len(a), len(b)), max(len(a), len(b))
    if not most:
        return 1.0
    w = weights(most)
    same = float(w[:n][a[:n] == b[:n]].sum())
    # of the steps that both have, one in sixteen agrees by chance
    shared = float(w[:n].sum())
    return max(0.0, (same - shared / 16) / (15 / 16)) / float(w.sum())


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars`` (code points) and ``fingerprint`` (hexadecimal) of every row of ``docs``.

    Null and empty texts have an empty fingerprint; equal texts have equal ones; null and repeated doc_ids stay as they are.
    """
    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        return {"doc_id": batch.column(0), "n_chars": [len(t) for t in texts], "fingerprint": [text_of(x) for x in fingerprints(texts)]}

    return map_rows(documents(docs), run, "doc_id long, n_chars long, fingerprint string", SLICE_CHARS)


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows ``part``, ``look``, ``key``, ``doc_id``, ``text``, each part in one task in the order of ``look``, ``key`` and ``text``.

    Parts are ranges of doc_id, null last. Where a part ends, the rows that begin the next one (after the last: the first) follow as a
    look ahead (``look`` 1), so each text meets the next one and is shuffled once.
    """
    key = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    rows = documents(docs).withColumn("key", key)
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low, cuts = docs.select(key.alias("key")).agg(F.min("key"), F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()
    cuts = sorted({c for c in cuts or () if c > low})
    bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>") if cuts else None
    part, begins = F.lit(0), F.lit(False)
    if bounds is not None:  # the number of bounds up to the key, by halving
        halves = [1 << k for k in reversed(range(len(cuts).bit_length()))]
        part = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda n, step: F.when(
            (n + step <= len(cuts)) & (F.get(bounds, n + step - 1) <= F.col("key")), n + step).otherwise(n))
        begins = F.coalesce(F.get(bounds, F.col("part") - 1) == F.col("key"), F.lit(False))
    place = lambda p, look: F.struct(p.alias("part"), F.lit(look).alias("look"))
    rows = rows.withColumn("part", part)
    ahead = F.when(begins, F.array(place(F.col("part") - 1, 1))).when(F.col("key") == F.lit(low), F.array(place(F.lit(len(cuts)), 1))).otherwise(
        F.array().cast("array<struct<part:int,look:int>>"))
    rows = rows.withColumn("at", F.explode(F.concat(F.array(place(F.col("part"), 0)), ahead))).select("at.part", "at.look", "key", "doc_id", "text")
    return rows.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "look", "key", "text")


PAIR = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Of every row: its fingerprint, that of its text edited by the next row's (in the order of doc_id, null last; after the last: the first),
    and how like it is to the edited text and to the next text. Of rows with the same doc_id, that with the smaller text comes first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for row in _rows(batches):
            held.append(row)
            size += len(row[3])
            if size > SLICE_CHARS:
                yield _compared(held)
                held, size = held[-1:], len(row[3])
        yield _compared(held)

    return with_next(docs).mapInArrow(run, PAIR)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in ("part", "look", "doc_id", "text")), strict=True)


def _compared(rows: list[tuple]) -> pa.RecordBatch:
    """Results of all rows but the last one and those of the look ahead."""
    pairs = [k for k in range(len(rows) - 1) if rows[k][1] == 0 and rows[k + 1][0] == rows[k][0]]
    texts = [r[3] for r in rows]
    changed = [edited(texts[k], texts[k + 1]) for k in pairs]
    need = sorted({j for k in pairs for j in (k, k + 1)})
    prints = fingerprints([texts[k] for k in need] + changed)
    own, other = dict(zip(need, prints, strict=False)), prints[len(need):]
    columns = {
        "doc_id": pa.array([rows[k][2] for k in pairs], pa.int64()), "n_chars": pa.array([len(texts[k]) for k in pairs], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        "fingerprint": pa.array([text_of(own[k]) for k in pairs], pa.string()), "edited_fingerprint": pa.array([text_of(x) for x in other], pa.string()),
        "near_edited": pa.array([likeness(own[k], x) for k, x in zip(pairs, other, strict=True)], pa.float64()),
        "near_next": pa.array([likeness(own[k], own[k + 1]) for k in pairs], pa.float64())}
    return pa.RecordBatch.from_pydict(columns)


def _short_classes(least: float) -> list[int]:
    """Lowest sizes of the classes of fingerprints shorter than two octaves, and what comes after the last; like ones are in a class or the next."""
    out = [1]
    while out[-1] < 2 * SAMPLES:
        out.append(min(2 * SAMPLES, max(out[-1] + 1, math.ceil(out[-1] / least))))
    return out


def buckets(samples: np.ndarray, least: float, bands: int, width: int) -> list[int]:
    """The buckets of a fingerprint.

    A band is ``width`` samples of the last two full octaves of the shorter of two fingerprints. Fingerprints below two octaves have one band more than
    like ones can differ in samples, and these share all samples of the smallest one, so like ones agree in a band for certain.
    """
    raw, n, out = samples.tobytes(), len(samples), []
    put = lambda *key: out.append(int.from_bytes(hashlib.blake2b(b"%d %d %d " % key[:3] + key[3], digest_size=8).digest(), "little", signed=True))
    octave = n // SAMPLES
    for b, pick in enumerate(_picks(bands, width)):
        for o in (octave, octave - 1):
            if o >= 2:
                put(0, o, b, samples[(o - 2) * SAMPLES + pick].tobytes())
    lows = _short_classes(least)
    for k, (low, high) in enumerate(itertools.pairwise(lows)):
        # the class of the fingerprint, the one before, and the last class if a longer one may be like its members
        if low <= n < high or k + 2 < len(lows) and high <= n < lows[k + 2] or high == 2 * SAMPLES <= n and least * weights(n).sum() <= high:
            parts = int(15 / 16 * (1 - least) * (high - 1) + 1e-9) + 1
            if parts > low:  # no band is certain: all of the class meet
                put(1, k, 0, b"")
                continue
            for b in range(parts):
                put(1, k, b, raw[b * low // parts:(b + 1) * low // parts])
    return out


@lru_cache(maxsize=4)
def _picks(bands: int, width: int) -> list[np.ndarray]:
    rng = np.random.default_rng(7)
    return [np.sort(rng.choice(2 * SAMPLES, width, replace=False)) for _ in range(bands)]


def _forest(parts: list[int], sides: list[int], prints: list[np.ndarray], least: float) -> list[tuple[int, int, float]]:
    """Like pairs (rows and likeness) that tie what the like pairs between different sides (if there is but one: all) tie, where rows of equal ``parts`` are tied."""
    n, both = len(parts), len(set(sides)) > 1
    sizes = np.array([len(x) for x in prints])
    rows = np.full((n, sizes.max()), 255, np.uint8)
    for row, x in zip(rows, prints, strict=True):
        row[:len(x)] = x
    w = weights(rows.shape[1])
    upto = np.concatenate([[0.0], np.cumsum(w)])
    mates: dict[int, list[int]] = {}
    for k, part in enumerate(parts):
        mates.setdefault(part, []).append(k)
    side, free, out = np.array(sides), np.ones(n, bool), []
    for seed in range(n):
        if not free[seed]:
            continue
        queue = list(mates[parts[seed]])
        free[queue] = False
        while queue:
            k = queue.pop()
            least_of = np.minimum(sizes, sizes[k])
            may = free & (upto[least_of] >= least * upto[np.maximum(sizes, sizes[k])])
            rest = np.flatnonzero(may & (side != side[k]) if both else may)
            if not len(rest):
                continue
            # as in likeness()
            same = (rows[rest, :sizes[k]] == rows[k, :sizes[k]]) @ w[:sizes[k]]
            like = np.maximum(0.0, (same - upto[least_of[rest]] / 16) / (15 / 16)) / upto[np.maximum(sizes[rest], sizes[k])]
            for j, x in zip(rest[like >= least].tolist(), like[like >= least].tolist(), strict=True):
                if free[j]:
                    out.append((k, j, x))
                    free[mates[parts[j]]] = False
                    queue += mates[parts[j]]
    return out


LINK = "doc_id long, leader long, likeness double"


def _verified(least: float):
    """Links of every group (``bucket``, ``a``, ``b``); the rows come by group."""
    schema = pa.schema([("doc_id", pa.int64()), ("leader", pa.int64()), ("likeness", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "a", "b", "id", "component", "side", "fingerprint")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, group in itertools.groupby(rows(batches), lambda r: r[:3]):
            _, _, _, ids, parts, sides, prints = zip(*group, strict=True)
            out += [(max(ids[j], ids[k]), min(ids[j], ids[k]), x) for j, k, x in _forest(parts, sides, [samples_of(p) for p in prints], least)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Groups (``bucket``, ``a``, ``b``) in which every two rows of a bucket meet that are in different components.

    A bucket of more than ``block`` rows is cut into chunks, each two of which are a group, with a ``side`` for each; a component of that size has chunks of its own,
    which do not meet each other.
    """
    sizes = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    totals = checkpointed(sizes.groupBy("bucket").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("parts"))
    rows = rows.join(totals, "bucket")
    hot = checkpointed(rows.filter(F.col("n") > block))
    cold = rows.filter(F.col("n") <= block).select("bucket", F.lit("").alias("a"), F.lit("").alias("b"), F.lit(0).alias("side"), "id", "component")
    large = checkpointed(hot.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > block))
    number = lambda of, n: F.pmod(F.xxhash64(of), F.ceil(F.col(n) / block)).cast("string")
    own = F.col("c").isNotNull()
    hot = checkpointed(hot.join(large, ["bucket", "component"], "left").select(
        "bucket", "id", "component", F.when(own, F.col("component")).alias("whole"),
        F.when(own, F.concat(F.lit("c"), F.col("component").cast("string"), F.lit(":"), number("id", "c"))).otherwise(F.concat(F.lit("s"), number("component", "n"))).alias("chunk")))
    chunks = hot.select("bucket", "chunk", "whole").distinct()
    groups = checkpointed(
        chunks.select("bucket", F.col("chunk").alias("a"), F.col("whole").alias("p")).join(chunks.select("bucket", F.col("chunk").alias("b"), F.col("whole").alias("q")), "bucket")
        .filter((F.col("a") <= F.col("b")) & ~F.coalesce(F.col("p") == F.col("q"), F.lit(False))).select("bucket", "a", "b"))
    for side, name in enumerate("ab"):
        met = groups if side == 0 else groups.filter("a < b")
        cold = cold.unionByName(hot.withColumnRenamed("chunk", name).join(met, ["bucket", name]).select("bucket", "a", "b", F.lit(side).alias("side"), "id", "component"))
    return cold


def near(prints: DataFrame, least: float = 0.8, bands: int = 12, width: int = 6, block: int = 256) -> DataFrame:
    """``doc_id``, ``leader`` (a smaller doc_id), ``likeness``: like documents, enough of them to tie all that share a bucket and are like.

    Rows with equal fingerprints meet at the one of smallest doc_id. Documents that agree in a band share a bucket (``buckets``). They are verified against its
    smallest doc_id first, which ties large groups of near copies by one pair per document; then all pairs of a bucket that are still in different
    components are verified, in blocks. Rows without doc_id or with an empty fingerprint are left out.
    """
    known = checkpointed(prints.select("doc_id", "fingerprint").filter(F.col("doc_id").isNotNull() & (F.length("fingerprint") > 0)))
    first = checkpointed(known.groupBy("fingerprint").agg(F.min("doc_id").alias("id")))
    posted = map_rows(first, lambda batch: {"id": batch.column("id"), "bucket": [
        buckets(samples_of(p), least, bands, width) for p in batch.column("fingerprint").to_pylist()]}, "id long, bucket array<long>")
    at = posted.select("id", F.explode("bucket").alias("bucket")).distinct()
    heads = checkpointed(at.groupBy("bucket").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    at = checkpointed(at.join(heads, "bucket"))
    one = first.withColumnRenamed("id", "leader").withColumnRenamed("fingerprint", "other")
    pairs = at.filter("id > head").select("id", F.col("head").alias("leader")).distinct().join(first, "id").join(one, "leader").select("id", "leader", "fingerprint", "other")

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "leader": batch.column(1), "likeness": [
            likeness(samples_of(a), samples_of(b)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]}

    star = checkpointed(map_rows(pairs, run, LINK).filter(F.col("likeness") >= least))
    parts = components(star, "doc_id", "leader").withColumnRenamed("node", "id")
    open_ = at.join(parts, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    groups = _dealt(checkpointed(open_), block).join(first, "id")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = groups.repartition(n, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b").mapInArrow(_verified(least), LINK)
    copies = known.join(first, "fingerprint").filter("doc_id > id").select("doc_id", F.col("id").alias("leader"), F.lit(1.0).alias("likeness"))
    return copies.unionByName(star).unionByName(rest).filter("doc_id > leader").groupBy("doc_id", "leader").agg(F.max("likeness").alias("likeness"))


def classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """``doc_id`` and ``class_id`` (the smallest doc_id that links of ``near`` reach) of every row of ``docs``; null without a doc_id."""
    parts = components(near(fingerprint(docs), least), "doc_id", "leader").withColumnRenamed("node", "doc_id")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(parts, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
