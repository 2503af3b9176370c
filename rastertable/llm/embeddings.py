"""Embedding near-dedup with a robust-pruned flat graph on overlapping cluster shards.

Equal vectors are one from the start. Centroids fitted on a bounded sample give each vector its nearest few clusters, so shards
overlap; each shard builds a graph, and the neighbour lists that a vector has in its shards are united. A shard then searches,
with the united lists, for all vectors in range of each of its own: greedily from its medoid, then outwards as long as
vectors within the range turn up. Cosines are checked in double precision. A sample of vectors is compared with all vectors; if
too few of their links were found, all is done again with more overlap.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertable.llm import flatgraph
from rastertable.llm.graph import components
from rastertable.llm.tables import checkpointed, join_small, map_rows, release_shuffles

SALTS = 16
CUTS = 3         # times that a shard is cut; what is still over the bound is sliced
SHIFT = 13       # bits of a shard's number for each of its parts
NOWHERE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Rule:
    """Pairs link from ``least`` on. ``sample`` (rows) and ``sample_bytes`` bound the vectors that centroids are fitted on, ``fitted`` those of a
    shard that is cut. ``audited`` vectors are compared with all; the share of their links found, pooled and as a mean of vectors, is at least ``recall``.
    A cluster is meant to have ``cluster`` vectors; of each vector's ``overlap`` nearest clusters those within ``margin`` hold it. A graph
    has about ``slice`` vectors at most, however many a shard holds."""

    least: float = 0.9
    sample: int = 1 << 16
    sample_bytes: int = 128 << 20
    fitted: int = 2048
    cluster: int = 800
    overlap: int = 3
    margin: float = 0.25
    audited: int = 1024
    recall: float = 0.97
    slice: int = 4096
    degree: int = 16
    beam: int = 24

    def wider(self) -> Rule:
        return replace(self, overlap=2 * self.overlap, margin=min(2.0, 1.5 * self.margin), degree=self.degree + 8, beam=2 * self.beam)


def prepared(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``digest`` and ``vec`` (doubles of unit length); the latter null for vectors that link with nothing."""
    def run(batch: pa.RecordBatch) -> dict:
        ids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        digests, units = [], []
        for i, v in zip(ids, raw, strict=True):
            v = None if i is None or not v or None in v else np.asarray(v, np.float64) + 0.0
            top = None if v is None else np.abs(v).max()
            good = v is not None and np.isfinite(top) and top > 0
            digests.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest() if good else None)
            units.append(((v / top) / np.linalg.norm(v / top)).tobytes() if good else None)
        return {"vec_id": batch.column(0), "digest": digests, "vec": units}

    return map_rows(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")),
                    run, "vec_id long, digest binary, vec binary")


def matrix(column) -> np.ndarray:
    """Vectors of several lengths are filled up with zeros behind a last number that keeps lengths apart when they are compared."""
    rows = [np.frombuffer(v, np.float64) for v in column]
    out = np.zeros((len(rows), max(map(len, rows))))
    for row, v in zip(out, rows, strict=True):
        row[:len(v)] = v
    return out


def centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[a:a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        used, first = np.unique(own[order], return_index=True)
        c[used] = np.add.reduceat(x[order], first, axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))[:, :width]


def nearest(x: np.ndarray, centres: np.ndarray, rule: Rule) -> list[list[int]]:
    """The clusters that hold each vector, ascending."""
    s = _fit(x, centres.shape[1]).astype(np.float32) @ centres.T
    best = np.argsort(-s, axis=1, kind="stable")[:, :rule.overlap]
    top = np.take_along_axis(s, best, 1)
    return [sorted(b[t >= t[0] - rule.margin].tolist()) for b, t in zip(best, top, strict=True)]


def sharded(one: DataFrame, centres: np.ndarray, rule: Rule) -> DataFrame:
    """``shard``, ``vec_id``, ``copies``, ``vec``, ``shards`` (all of the vector's, ascending): a row for each."""
    def run(batch: pa.RecordBatch) -> dict:
        own = nearest(matrix(batch.column(2).to_pylist()), centres, rule)
        return {"vec_id": batch.column(0), "copies": batch.column(1), "vec": batch.column(2), "shards": own}

    wide = map_rows(one.select("vec_id", "copies", "vec"), run, "vec_id long, copies long, vec binary, shards array<long>")
    return wide.select(F.explode("shards").alias("shard"), "vec_id", "copies", "vec", "shards")


def _finer(rule: Rule):
    """Centroids of a shard from a sample of it; none where linked vectors of the sample would be parted or no part is small."""
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        shard, size = (int(k) for k in key)
        x = matrix(group["vec"])
        k = min(-(-size // rule.cluster), len(x) // 8)
        found = pd.DataFrame({"shard": [shard], "parts": [-(-size // rule.slice)], "width": [x.shape[1]], "centres": [b""]})
        if k < 2:
            return found[:0]
        centres = centroids(x, k)
        member = np.zeros((len(x), k), np.float32)
        for row, own in zip(member, nearest(x, centres, rule), strict=True):
            row[own] = 1
        linked_ = np.triu(x @ x.T >= rule.least, 1)
        together = (linked_ & (member @ member.T > 0)).sum()
        if 2 * together < (1 + rule.recall) * linked_.sum() or member.mean(0).max() > 0.5:
            return found[:0]
        return found.assign(centres=[centres.astype(np.float32).tobytes()])
    return run


def _dealt(rule: Rule):
    def run(key: tuple, group: pd.DataFrame, finer: pd.DataFrame) -> pd.DataFrame:
        if group.empty:
            return group[["shard", "vec_id", "copies", "vec"]]
        centres = np.frombuffer(finer["points"].iloc[0], np.float32).reshape(-1, int(finer["wide"].iloc[0]))
        own = nearest(matrix(group["vec"]), centres, rule)
        rows = np.repeat(np.arange(len(group)), [len(o) for o in own])
        base = (int(key[0]) + 1) << SHIFT
        return group.iloc[rows][["vec_id", "copies", "vec"]].assign(shard=base + np.concatenate(own).astype(np.int64))
    return run


def cut(rows: DataFrame, rule: Rule) -> DataFrame:
    """``sharded`` rows, those of shards over ``slice`` vectors dealt out to finer shards where that parts few links."""
    for _ in range(CUTS):
        large = checkpointed(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > rule.slice))
        drawn = F.pmod(F.xxhash64("vec_id", "shard"), F.lit(1 << 30)) < F.lit(rule.fitted * float(1 << 30)) / F.col("size")
        sample = join_small(rows.select("shard", "vec_id", "vec"), large, ["shard"]).filter(drawn)
        finer = checkpointed(sample.groupBy("shard", "size").applyInPandas(_finer(rule), "shard long, parts int, width int, centres binary"))
        if finer.isEmpty():
            return rows
        marked = join_small(rows, finer.select("shard", F.col("parts").alias("salts")), ["shard"], how="left")
        salted = marked.filter("salts IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int"))
        spread = finer.select(F.col("shard").alias("of"), F.col("width").alias("wide"), F.col("centres").alias("points"),
                              F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        dealt = salted.groupBy("shard", "salt").cogroup(spread.groupBy("of", "part")).applyInPandas(
            _dealt(rule), "shard long, vec_id long, copies long, vec binary")
        rows = marked.filter("salts IS NULL").select(*dealt.columns).unionByName(dealt).withColumn("sum", F.xxhash64("vec"))
        rows = checkpointed(rows)
        held = rows.groupBy("vec_id", "sum").agg(F.array_sort(F.collect_set("shard")).alias("shards"))
        rows = checkpointed(rows.join(held, ["vec_id", "sum"]).select("shard", "vec_id", "copies", "vec", "shards"))
    return rows


def _same_length(lengths: np.ndarray) -> list[np.ndarray]:
    return [np.flatnonzero(lengths == n) for n in np.unique(lengths)]


def _built(rule: Rule):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, parts = group["vec_id"].to_numpy(), []
        lengths = group["vec"].map(len).to_numpy()
        for rows in _same_length(lengths):
            edges = flatgraph.build(matrix(group["vec"].iloc[rows]), rule.degree, rule.beam)
            own = ids[rows]
            parts.append(pd.DataFrame({"vec_id": own, "near": [own[e[e >= 0]] for e in edges]}))
        return pd.concat(parts)
    return run


def _lists(lists, fill: int) -> np.ndarray:
    out = np.full((len(lists), max(1, *map(len, lists)) if len(lists) else 1), fill, np.int64)
    for row, own in zip(out, lists, strict=True):
        row[:len(own)] = own
    return out


def _searched(rule: Rule):
    """Links of the rows ``asked`` among those that are a ``node`` (of a slice)."""
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        parts = [pd.DataFrame({"vec_id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})]
        lengths = group["vec"].map(len).to_numpy()
        for rows in _same_length(lengths):
            alike = group.iloc[rows]
            nodes, asked = alike[alike["node"]].sort_values("vec_id"), alike[alike["asked"]].sort_values("vec_id")
            if not len(nodes) or not len(asked):
                continue
            ids, copies, x = nodes["vec_id"].to_numpy(), nodes["copies"].to_numpy(), matrix(nodes["vec"])
            at = lambda e: np.minimum(np.searchsorted(ids, e), len(ids) - 1)
            # of the united lists, those in this slice
            edges = _lists([a[ids[a] == e] for e in map(np.asarray, nodes["near"]) for a in [at(e)]], flatgraph.NONE)
            asked_ids, vectors = asked["vec_id"].to_numpy(), matrix(asked["vec"])
            place = at(asked_ids)
            place = np.where(ids[place] == asked_ids, place, flatgraph.NONE)
            held, holds = _lists(nodes["shards"].tolist(), NOWHERE), _lists(asked["shards"].tolist(), NOWHERE)
            start, step = np.array([flatgraph.medoid(x)]), max(16, (1 << 20) // len(ids))
            for a in range(0, len(asked_ids), step):
                q, node = flatgraph.in_range(x, edges, vectors[a:a + step], place[a:a + step], start, rule.least)
                q += a
                # a pair counts in the first shard that holds both
                both = (holds[q][:, :, None] == held[node][:, None, :]).any(2)
                mine = np.where(both, holds[q], NOWHERE).min(1, initial=NOWHERE) == shard
                q, node = q[mine], node[mine]
                some, row = np.unique(q, return_inverse=True)
                parts.append(pd.DataFrame({"vec_id": asked_ids[some], "links": np.bincount(row, copies[node], len(some)).astype(np.int64), "root": asked_ids[some]}))
                a_, b_ = _forest(asked_ids[q], ids[node])
                parts.append(pd.DataFrame({"vec_id": a_, "links": np.zeros(len(a_), np.int64), "root": b_}))
        return pd.concat(parts)
    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from nodes to the smallest node of their component of the pairs."""
    if not len(a):
        return a, b
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = both[:len(a)], both[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(one: DataFrame, centres: np.ndarray, rule: Rule) -> DataFrame:
    """``vec_id``, ``links`` and ``root``: a row for each vector and slice with its links there, and rows that tie components."""
    rows = cut(checkpointed(sharded(one, centres, rule)), rule)
    sizes = checkpointed(rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(rule.slice)).cast("int").alias("slices")))
    tasks = lambda column: min(20_000, max(2, int(sizes.agg(F.sum(column)).first()[0])))
    rows = join_small(rows, sizes, ["shard"]).withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int"))
    grouped = rows.repartition(tasks(F.col("slices")), "shard", "slice").groupBy("shard", "slice")
    graph = grouped.applyInPandas(_built(rule), "vec_id long, near array<long>")
    united = graph.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    # a row is a node of its slice wherever that is searched, and is asked for in all slices of its shard
    every = F.sequence(F.lit(0), F.col("slices") - 1)
    own = rows.join(checkpointed(united), "vec_id").withColumn("of", F.explode(every)).select(
        "shard", "slice", "of", "vec_id", "copies", "vec", "shards", "near", F.lit(True).alias("node"), (F.col("of") == F.col("slice")).alias("asked"))
    other = (rows.filter("slices > 1").withColumn("at", F.explode(F.array_remove(every, F.col("slice")))).select(
        "shard", F.col("at").alias("slice"), F.col("slice").alias("of"), "vec_id", "copies", "vec", "shards",
        F.lit(None).cast("array<long>").alias("near"), F.lit(False).alias("node"), F.lit(True).alias("asked")))
    split = own.unionByName(other).repartition(tasks(F.col("slices") * F.col("slices")), "shard", "slice", "of")
    return checkpointed(split.groupBy("shard", "slice", "of").applyInPandas(_searched(rule), "vec_id long, links long, root long"))


def audit(one: DataFrame, links: DataFrame, rule: Rule) -> float:
    """Share of their links (copies counted) found for the ``audited`` vectors with the smallest digests, compared with all vectors: the
    smaller one of all links together and of the mean of vectors, so that neither a large group nor many small ones can hide the rest. 1 without links."""
    asked = one.orderBy("digest").limit(rule.audited).select("vec_id", "vec").collect()
    if not asked:
        return 1.0
    ids = [r.vec_id for r in asked]
    vecs = [bytes(r.vec) for r in asked]
    least = rule.least

    def run(batches):
        for batch in batches:
            own, copies = batch.column("vec").to_pylist(), np.array(batch.column("copies").to_pylist())
            total = np.zeros(len(ids), np.int64)
            for n in {len(v) for v in own}:
                rows = [k for k, v in enumerate(own) if len(v) == n]
                mine = [k for k, v in enumerate(vecs) if len(v) == n]
                if mine:
                    hits = matrix([vecs[k] for k in mine]) @ matrix([own[k] for k in rows]).T >= least
                    hits &= np.array([ids[k] for k in mine])[:, None] != np.array(batch.column("vec_id").to_pylist())[rows][None, :]
                    total[mine] += hits @ copies[rows]
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "n": pa.array(total)})

    there = one.select("vec_id", "copies", "vec").mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n")).filter("n > 0")
    found = links.filter(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.sum("links").alias("links"))
    share = F.coalesce("links", F.lit(0)) / F.col("n")
    pooled, mean = there.join(found, "vec_id", "left").agg(F.sum(F.coalesce("links", F.lit(0))) / F.sum("n"), F.avg(share)).first()
    return 1.0 if pooled is None else min(pooled, mean)


def linked(vectors: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of ``vectors``.

    Vectors that are null, empty, zero or hold a null or non-finite number link with nothing; only vectors of equal length link.
    A row without vec_id links with nothing, has no component and is kept. Rows with the same vec_id count one by one as links. An empty table
    gives an empty table; other columns are not looked at.
    """
    rows = checkpointed(prepared(vectors))
    one = checkpointed(rows.filter(F.col("vec").isNotNull()).groupBy("digest").agg(F.min(F.struct("vec_id", "vec")).alias("own"), F.count(F.lit(1)).alias("copies"))
                       .select("digest", "own.vec_id", "own.vec", "copies"))
    n = one.count()
    told = one.withColumns({"links": F.lit(0).cast("long"), "component": F.col("vec_id")})
    if n:
        width = one.agg(F.max(F.length("vec"))).first()[0]
        taken = max(1024, min(rule.sample, rule.sample_bytes // width))
        sample = matrix([r.vec for r in one.select("digest", "vec").orderBy("digest").limit(taken).select("vec").collect()])
        centres = centroids(sample, int(min(max(1, -(-n // rule.cluster)), max(1, len(sample) // 8))))
        while True:
            found = _links(one, centres, rule)
            if (share := audit(one, found, rule)) >= rule.recall:
                break
            if rule.overlap >= len(centres) and rule.margin >= 2 and rule.beam >= 512:
                raise RuntimeError(f"{share:.4f} of the audited links were found, {rule.recall} are asked for")
            rule = rule.wider()
            release_shuffles(one.sparkSession)
        parts = components(found.filter("vec_id != root").select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
        told = (one.join(found.groupBy("vec_id").agg(F.sum("links").alias("links")), "vec_id", "left")
                .join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left"))
    told = told.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    # a vector with very many copies: its row is repeated under every salt, its copies are spread over them
    salted = told.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    keyed = rows.select("vec_id", "digest", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    component = F.coalesce("component_id", "vec_id")
    return keyed.join(salted, ["digest", "salt"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
