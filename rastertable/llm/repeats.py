"""Removal of byte strings that an earlier document holds too, by suffix order.

Equal texts are settled first. Of the rest, every string of the given length has a key: the least hash of the shorter strings
within it. Runs of strings with one key are segments; only segments whose key occurs in several documents can hold a repeat. Keys meet in
buckets, sorted arrays of them, and what is shared goes back to its documents. Segments of shared keys are then counted by content, and the
contents of those keys that have several, a shard for each range of keys, are put in suffix order by induced sorting, where equal strings stand side by
side; the smallest doc_id of each such class tells for every document which of its strings an earlier one has. Contents of a key with more segments
than a shard holds are split into their strings, which meet one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertable.llm.induced import suffix_order
from rastertable.llm.tables import checkpointed, documents, join_small, map_rows, new_folder, release, release_shuffles, slices
from rastertable.llm.words import hashes, mix, utf8

GRAM = 20
#: Bits of a key within its bucket; a bucket holds far fewer keys, so hardly two of them agree by chance, which would cost only a look.
BITS = 40
#: Up to so many keys, and documents that are copies of an earlier one, are broadcast.
FEW_KEYS, FEW_COPIES = 100_000, 2_000_000
#: More keys meet their segments in so many rounds, a share of the keys in each, so that only a share of the segments is on its way at a time.
ROUNDS = 4
SLICE, SHARD_BYTES = 2 << 20, 3 << 19
LAST = (1 << 63) - 1
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def segments(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings of ``length`` bytes with one key: row, first and last start (in ``data``), key."""
    n, width = len(data), length - GRAM + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((n + 1,), "<u8", padded.data, strides=(1,))
    count = n - GRAM + 1
    g = eight[:count] * _M[0]
    g += eight[8:8 + count] * _M[1]
    g ^= g >> np.uint64(31)
    g += eight[GRAM - 8:GRAM - 8 + count] * _M[2]
    g = mix(g)
    size, low = 1, g
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[:len(low) - (width - size)], low[width - size:])
    ok = np.zeros(n - length + 2, np.int8)
    long = np.diff(at) >= length
    np.add.at(ok, at[:-1][long], 1)
    np.add.at(ok, at[1:][long] - length + 1, -1)
    ok = np.cumsum(ok[:-1], dtype=np.int8).astype(bool)
    same = np.zeros(len(low), bool)
    same[1:] = (low[1:] == low[:-1]) & ok[1:] & ok[:-1]
    first = np.flatnonzero(ok & ~same)
    last = np.flatnonzero(ok & ~np.append(same[1:], False))
    return np.searchsorted(at, first, "right") - 1, first, last, low[first]


def _keys(buckets: int, length: int):
    """Rows ``bucket``, ``doc``, ``keys``, ``owners``. A key that several documents of a slice share is told to them at once (a row with ``doc``), and
    goes to its bucket only once, without an owner (in a row whose ``owners`` are null)."""
    schema = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, SLICE)):
            docs = np.array(batch.column(0).to_pylist(), np.int64)
            row, _, _, key = segments(*utf8(batch.column(1)), length)
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")  # rows ascend within a key
            key, row = key[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            last = np.append(first[1:], len(key)) - 1
            local = row[first] != row[last]
            owner = docs[row[first]]
            unique = key[first]
            code = codes(unique, buckets)
            bucket = (code >> np.uint64(BITS)).astype(np.int32)
            order = np.lexsort((row[first], local, bucket))
            cuts = np.searchsorted(2 * bucket[order] + local[order], np.arange(2 * buckets + 1))
            short = code.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BITS // 8]
            out = [(b // 2, None, short[o].tobytes(), None if b % 2 else owner[o].tobytes()) for b in range(2 * buckets) if len(o := order[cuts[b]:cuts[b + 1]])]
            told = np.repeat(local, last - first + 1)
            order = np.argsort(row[told], kind="stable")
            mine, own = row[told][order], codes(key[told][order], buckets)
            for k in np.split(np.arange(len(mine)), np.flatnonzero(mine[1:] != mine[:-1]) + 1) if len(mine) else ():
                doc = int(docs[mine[k[0]]])
                out.append((doc % buckets, doc, np.unique(own[k]).tobytes(), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = key = row = order = owner = bucket = mine = own = None
            release()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one bucket: ``doc`` and those of its ``keys`` that several slices hold; rows with a document go through."""
    schema = pa.schema([("doc", pa.int64()), ("keys", pa.binary())])
    keys, owners, owned = [], [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        direct = batch.filter(batch.column("doc").is_valid())
        if direct.num_rows:
            yield pa.RecordBatch.from_arrays([direct.column("doc"), direct.column("keys")], schema=schema)
        rest = batch.filter(batch.column("doc").is_null())
        for b, k, o in zip(*(rest.column(n).to_pylist() for n in ("bucket", "keys", "owners")), strict=True):
            wide = np.zeros((len(k) // (BITS // 8), 8), np.uint8)
            wide[:, :BITS // 8] = np.frombuffer(k, np.uint8).reshape(len(wide), -1)
            keys.append(wide.view("<u8").ravel() | np.uint64(b << BITS))
            owners.append(np.zeros(len(wide), np.int64) if o is None else np.frombuffer(o, np.int64))
            owned.append(np.full(len(wide), o is not None))
    if keys:
        key, owner, own = np.concatenate(keys), np.concatenate(owners), np.concatenate(owned)
        del keys, owners, owned
        order = np.argsort(key, kind="stable")
        key, owner, own = key[order], owner[order], own[order]
        equal = key[1:] == key[:-1]
        use = (np.append(equal, False) | np.append(False, equal)) & own
        key, owner = key[use], owner[use]
        order = np.argsort(owner, kind="stable")
        key, owner = key[order], owner[order]
        cuts = np.flatnonzero(owner[1:] != owner[:-1]) + 1
        for a in range(0, len(owner) and len(cuts) + 1, 10_000):
            ends = [0, *cuts.tolist(), len(owner)][a:a + 10_001]
            yield pa.RecordBatch.from_arrays([pa.array(owner[ends[:-1]]), pa.array([key[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], schema=schema)


def _packed(df: DataFrame) -> DataFrame:
    """Texts compressed ahead of a shuffle."""
    def run(batch: pa.RecordBatch) -> dict:
        raw = [t.as_buffer() for t in batch.column(2)]
        return {"doc": batch.column(0), "uid": batch.column(1), "size": [r.size for r in raw], "packed": [pa.compress(r, codec="zstd", asbytes=True) if r.size else b"" for r in raw]}

    return map_rows(df.select("doc", "uid", "text"), run, "doc long, uid long, size long, packed binary")


def _unpacked(packed: bytes, size: int) -> bytes:
    return pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


SEGMENT = "key long, doc long, uid long, start long, size int, digest long, content binary"


def codes(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A key's bucket, and ``BITS`` bits of it below."""
    h = mix(keys ^ _M[1])
    return (h >> np.uint64(BITS)) % np.uint64(buckets) << np.uint64(BITS) | h & np.uint64((1 << BITS) - 1)


def _cut(length: int, buckets: int):
    """The segments of a document whose keys are shared."""
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("uid", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("digest", pa.int64()), ("content", pa.binary())])

    def cut(docs: list[tuple]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"".join(d[2] for d in docs), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(d[2]) for d in docs])])
        row, first, last, key = segments(data, at, length)
        told = [np.frombuffer(d[3], np.uint64) for d in docs]
        # a key counts for the documents that were told of it; two that agree by chance cost only a look
        of = lambda code, r: mix(code ^ mix(r.astype(np.uint64) + _M[2]))
        wanted = of(np.concatenate(told), np.repeat(np.arange(len(docs)), [len(t) for t in told]))
        use = np.isin(of(codes(key, buckets), row), wanted)
        row, first, last, key = row[use], first[use], last[use], key[use]
        doc, uid = (np.array([d[k] for d in docs], np.int64) for k in (0, 1))
        for x in range(0, len(key), 20_000):
            r, begin, size = row[x:x + 20_000], first[x:x + 20_000], last[x:x + 20_000] - first[x:x + 20_000] + length
            ends = np.concatenate([[0], np.cumsum(size)])
            content = data[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
            yield pa.RecordBatch.from_arrays([
                pa.array(key[x:x + 20_000].view(np.int64)), pa.array(doc[r]), pa.array(uid[r]), pa.array(begin - at[r]), pa.array(size.astype(np.int32)),
                pa.array(hashes(data, begin, begin + size).view(np.int64)),
                pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(content)])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held = [], 0
        for batch in batches:
            for doc, uid, size, packed, keys in zip(*(batch.column(n).to_pylist() for n in ("doc", "uid", "size", "packed", "keys")), strict=True):
                docs.append((doc, uid, _unpacked(packed, size), b"".join(keys)))
                held += size
                if held > SLICE // 2:
                    yield from cut(docs)
                    docs, held = [], 0
            release()
        if docs:
            yield from cut(docs)

    return run


def earliest(contents: list[bytes], docs: np.ndarray, length: int) -> list[list[tuple[int, int, int]]]:
    """For each content, runs (start, number, doc) of its strings of ``length`` bytes by the smallest doc of all contents that hold the string."""
    sizes = np.array([len(c) for c in contents])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    raw = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    t = raw.astype(np.int64) + 1
    t[begin[1:] - 1] = 0
    inside = np.zeros(len(t) + 1, np.int64)
    np.add.at(inside, begin[:-1], 1)
    np.add.at(inside, begin[:-1] + np.maximum(0, sizes - length + 1), -1)
    window = np.cumsum(inside[:-1]) > 0
    order = suffix_order(t, length)
    order = order[window[order]]
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in [*range(0, length - 8, 8), length - 8]:
        new[1:] |= eight[order[1:] + k] != eight[order[:-1] + k]
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    least = np.minimum.reduceat(docs[owner[order]], np.flatnonzero(new)) if len(order) else order
    value = np.full(len(t), -1)
    value[order] = least[np.cumsum(new) - 1]
    change = np.flatnonzero(window & (np.concatenate([[True], (value[1:] != value[:-1]) | ~window[:-1]])))
    stops = np.flatnonzero(window & np.concatenate([(value[1:] != value[:-1]) | ~window[1:], [True]]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in contents]
    for a, b, k in zip(change.tolist(), stops.tolist(), owner[change].tolist(), strict=True):
        out[k].append((a - int(begin[k]), b - a + 1, int(value[a])))
    return out


RUNS = "key long, digest long, runs array<struct<at:long,n:long,doc:long>>"


def _resolved(length: int):
    """Runs of every content, of shards of whole keys at a time; the rows come by key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("key", "content", "low", "high", "digest")), strict=True):
                if size > SHARD_BYTES and row[0] != rows[-1][0]:
                    yield done(rows)
                    rows, size = [], 0
                    release()
                rows.append(row)
                size += len(row[1])
        if rows:
            yield done(rows)

    schema = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("runs", pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64()), ("doc", pa.int64())])))])

    def done(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for (key, _, _, high, digest), runs in zip(rows, earliest([r[1] for r in rows], np.array([r[2] for r in rows], np.int64), length), strict=True):
            runs = [{"at": a, "n": n, "doc": d} for a, n, d in runs if d < high]  # some document has an earlier one
            if runs:
                out.append({"key": key, "digest": digest, "runs": runs})
        return pa.RecordBatch.from_pylist(out, schema=schema)

    return run


STRING = "string binary, key long, digest long, low long, high long, places array<long>"


def _strings(length: int):
    """The strings of ``length`` bytes of every content with their places, of at most 65,536 places at a time."""
    schema = pa.schema([("string", pa.binary()), ("key", pa.int64()), ("digest", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("places", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for key, digest, content, low, high in zip(*(batch.column(n).to_pylist() for n in ("key", "digest", "content", "low", "high")), strict=True):
                last = len(content) - length + 1
                for a in range(0, last, 1 << 16):
                    places: dict[bytes, list[int]] = {}
                    for i in range(a, min(last, a + (1 << 16))):
                        places.setdefault(content[i:i + length], []).append(i)
                    out += [(string, key, digest, low, high, at) for string, at in places.items()]
                    if len(out) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _runs(batch: pa.RecordBatch) -> dict:
    out: list[list[dict]] = []
    for found in batch.column("found").to_pylist():
        runs: list[dict] = []
        for at, doc in sorted((at, f["doc"]) for f in found for at in f["places"]):
            if runs and runs[-1]["doc"] == doc and runs[-1]["at"] + runs[-1]["n"] == at:
                runs[-1]["n"] += 1
            else:
                runs.append({"at": at, "n": 1, "doc": doc})
        out.append(runs)
    return {"key": batch.column("key"), "digest": batch.column("digest"), "runs": out}


def _split(contents: DataFrame, length: int) -> DataFrame:
    """Runs as of ``_resolved``, without a task that holds a whole key."""
    strings = contents.select("key", "digest", "content", "low", "high").mapInArrow(_strings(length), STRING)
    least = strings.groupBy("string").agg(F.min("low").alias("doc"))
    found = (strings.join(least, "string").filter("doc < high").groupBy("key", "digest").agg(F.collect_list(F.struct("places", "doc")).alias("found")))
    return map_rows(found, _runs, RUNS)


def _removed(batch: pa.RecordBatch) -> dict:
    out: dict = {"doc": batch.column("doc"), "uid": batch.column("uid"), "spans": [], "kept": []}
    for size, packed, spans in zip(*(batch.column(n).to_pylist() for n in ("size", "packed", "spans")), strict=True):
        text, merged = _unpacked(packed, size), []
        for a, b in sorted((s["a"], s["b"]) for s in spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        ends = [0, *(x for m in merged for x in m), size]
        out["spans"].append([{"a": a, "b": b} for a, b in merged])
        out["kept"].append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
    return out


def without_repeats(docs: DataFrame, length: int = 50, buckets: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (a, b) of removed bytes and the sha256 of what is kept (``kept_sha256``), of every row of ``docs``.

    A byte goes if a string of ``length`` bytes (32 at least) around it also starts in a document with a smaller doc_id. Null texts are empty; a null doc_id is larger than
    all others; rows of the same doc_id do not take from each other. Keys with segments of
    more than ``shard_bytes`` in all are settled by their strings. An empty table gives an empty table; other columns are not looked at.
    """
    spark = docs.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents(docs).select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.octet_length("text").cast("long").alias("n_bytes"),
                                  F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "text").withColumn("uid", F.xxhash64("sha"))
    # copies are found, and joined, without their texts
    ids = checkpointed(rows.drop("text"))
    copies = checkpointed(ids.groupBy("sha").agg(F.min("doc").alias("low"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"))
    ids = checkpointed(join_small(ids, copies, ["sha"], how="left"))
    texts = rows.filter(F.col("n_bytes") >= length).select("doc", "uid", "text")
    texts = _originals(texts, checkpointed(ids.groupBy("doc").agg(F.bool_and(F.coalesce(F.col("low") < F.col("doc"), F.lit(False))).alias("copy")).filter("copy").select("doc")))
    del copies
    told = checkpointed(texts.select("doc", "text").mapInArrow(_keys(buckets, length), "bucket int, doc long, keys binary, owners binary")
                        .repartitionById(buckets, F.col("bucket")).mapInArrow(_shared, "doc long, keys binary").groupBy("doc").agg(F.collect_list("keys").alias("keys")))
    release_shuffles(spark)  # the keys go before the texts are sent
    folder = new_folder(spark, "segments")
    _packed(texts).join(told, "doc").mapInArrow(_cut(length, buckets), SEGMENT).write.option("compression", "zstd").parquet(folder)
    del told
    release_shuffles(spark)
    cut = spark.read.schema(SEGMENT).parquet(folder)
    keys = checkpointed(cut.groupBy("key").agg(F.min("digest").alias("digest"), F.max("digest").alias("e"), F.min("doc").alias("low"), F.max("doc").alias("high"),
                                               F.max("size").alias("size"), F.sum("size").alias("bytes"))
                        .filter("high > low").select("key", "digest", "low", "size", (F.col("digest") != F.col("e")).alias("several"), (F.col("bytes") > shard_bytes).alias("hot")))
    release_shuffles(spark)
    runs = _runs_of(cut.select("key", "digest", "content", "doc"), keys, length)
    # a key with one content needs no order: all but its first documents lose the whole segment
    run = F.struct(F.lit(0).cast("long").alias("at"), (F.col("size") - length + 1).cast("long").alias("n"), F.col("low").alias("doc"))
    runs = runs.unionByName(keys.filter("NOT several").select("key", "digest", F.array(run).alias("runs")))
    del keys
    span = F.struct((F.col("start") + F.col("run.at")).alias("a"), (F.col("start") + F.col("run.at") + F.col("run.n") - 1 + length).alias("b"))
    found = (cut.select("key", "doc", "uid", "start", "digest").join(runs, ["key", "digest"])
             .select("doc", "uid", "start", F.explode("runs").alias("run")).filter("run.doc < doc").select("doc", "uid", span.alias("span")))
    spans = checkpointed(found.groupBy("doc", "uid").agg(F.collect_list("span").alias("spans")))
    del found, runs
    release_shuffles(spark)
    changed = (map_rows(_packed(texts).join(spans, ["doc", "uid"]), _removed, "doc long, uid long, spans array<struct<a:long,b:long>>, kept binary")
               .select("doc", "uid", "spans", F.sha2("kept", 256).alias("kept_sha256")))
    whole = F.when((F.coalesce("low", "doc") < F.col("doc")) & (F.col("n_bytes") >= length), F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n_bytes").alias("b"))))
    return ids.select("doc_id", "doc", "uid", "n_bytes", "sha", whole.alias("whole")).join(changed, ["doc", "uid"], "left").select(
        "doc_id", "n_bytes", F.coalesce("whole", "spans", F.array().cast("array<struct<a:long,b:long>>")).alias("spans"),
        F.when(F.col("whole").isNotNull(), F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"))


def _originals(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """Texts without the documents ``copies``, of which an earlier document has every text. They would lose all and take from nobody, so leaving them out saves work only."""
    if copies.count() <= FEW_COPIES:
        return texts.join(F.broadcast(copies), "doc", "left_anti")
    folder = new_folder(texts.sparkSession, "texts")  # sent once, not for each step that reads it
    texts.join(copies, "doc", "left_anti").write.option("compression", "zstd").parquet(folder)
    release_shuffles(texts.sparkSession)
    return texts.sparkSession.read.schema(texts.schema).parquet(folder)


def _runs_of(pieces: DataFrame, keys: DataFrame, length: int) -> DataFrame:
    """Runs, computed now, of the contents of ``keys`` that have several. Segments (``pieces``) meet many keys once, by key; hot ones, of which there is one at most for each
    shard that the segments fill, are kept out of that."""
    hot, several = keys.filter("hot").select("key", "several"), keys.filter("several AND NOT hot").select("key")
    contents = lambda own: own.groupBy("key", "digest", "content").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    if several.count() <= FEW_KEYS:
        parts = [pieces.join(F.broadcast(several), "key")]
    else:
        share = lambda df, k: df.filter(F.pmod(F.xxhash64("key"), F.lit(ROUNDS)) == k)
        cold = pieces.join(F.broadcast(hot.select("key")), "key", "left_anti")
        parts = [share(cold, k).join(share(several, k), "key") for k in range(ROUNDS)]
    parts = [contents(own).repartition("key").sortWithinPartitions("key", "digest").mapInArrow(_resolved(length), RUNS) for own in parts]
    hot = hot.filter("several").select("key")
    if hot.limit(1).count():
        parts.append(_split(checkpointed(contents(pieces.join(F.broadcast(hot), "key"))), length))
    runs = None
    while parts:
        part = checkpointed(parts.pop())
        runs = part if runs is None else runs.unionByName(part)
        release_shuffles(pieces.sparkSession)
    return runs
