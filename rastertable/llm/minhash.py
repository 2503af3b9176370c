"""MinHash near-dedup by an inverted join on signature coordinates.

A document posts itself under each (coordinate, value) pair of its signature. Two documents are candidates if they collide in at
least ``matches`` of the ``coordinates``. Only pairs that more than one document posts count; a document with fewer such postings than
``matches`` has no candidate at all. The others are ordered from rare to frequent, and a pair that collides often enough must
collide within the first ``s - matches + 1`` of a document's ``s`` postings (prefix), so the frequent lists are skipped
wherever a document has enough rare ones. Candidates are confirmed on the full shingle sets.

Equal sets are one document from the start. Within a list, every document is first confirmed against the most central one (whose own
postings are the most frequent), which links large groups of near copies by one pair per document. Pairs around one centre that
are still apart must share additions to it or enough of it, which is told without pairing all of them; of other lists, pairs
between different components are joined, those outside the list's largest component against the rest.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertable.llm.graph import components
from rastertable.llm.tables import checkpointed, documents, free_name, join_small, map_rows, new_folder, release_shuffles
from rastertable.llm.words import NOT_SPACE, hashes, lower, shingles, split, utf8


@dataclass(frozen=True)
class Rule:
    """Words of a shingle; linked from ``percent`` of the union. ``matches`` is five deviations below what such pairs collide in."""

    words: int = 5
    percent: int = 80
    coordinates: int = 48
    seed: int = 11

    @property
    def matches(self) -> int:
        p = self.percent / 100
        return max(1, int(self.coordinates * p - 5 * (self.coordinates * p * (1 - p)) ** 0.5))


def sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z in lower case, words between white space."""
    data, at = utf8(column)
    data = lower(data)
    own = split(data, at, NOT_SPACE)
    h, begin = shingles(hashes(data, own.start, own.stop), own.first, words)
    return [np.unique(h[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def signatures(own: list[np.ndarray], rule: Rule) -> np.ndarray:
    """A row of (coordinate, value) pairs as integers for each set; sets may not be empty."""
    rng = np.random.default_rng(rule.seed)
    seeds = rng.integers(0, 2**63, (2, rule.coordinates), np.uint64) * np.uint64(2) + np.uint64(1)
    every = np.concatenate(own)
    first = np.cumsum([0, *map(len, own)])[:-1]
    out = np.empty((len(own), rule.coordinates), np.int64)
    for k in range(rule.coordinates):
        x = (every ^ seeds[0, k]) * seeds[1, k]
        x ^= x >> np.uint64(32)
        x *= seeds[0, k]
        out[:, k] = (np.minimum.reduceat(x, first) >> np.uint64(32)).astype(np.int64) | k << 32
    return out


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def posted(docs: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id``, ``n`` (size of the set), ``digest`` of the set and ``postings``; the latter null for an empty set or no doc_id."""
    def run(batch: pa.RecordBatch) -> dict:
        own, ids = sets(batch.column(1), rule.words), batch.column(0).to_pylist()
        full = [i for i, s in enumerate(own) if len(s) and ids[i] is not None]
        rows: list = [None] * len(own)
        if full:
            for i, row in zip(full, signatures([own[i] for i in full], rule), strict=True):
                rows[i] = row
        return {"doc_id": batch.column(0), "n": [len(s) for s in own], "digest": [None if r is None else digest(s) for r, s in zip(rows, own, strict=True)],
                "postings": rows}

    return map_rows(documents(docs), run, "doc_id long, n long, digest binary, postings array<long>", 2 << 20)


def _collisions(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def _may_link(n: str, m: str, rule: Rule) -> Column:
    """Sizes that allow the similarity asked for."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * rule.percent


def _compared(pairs: DataFrame, full: DataFrame, rule: Rule) -> DataFrame:
    """``a``, ``b``, sizes ``n`` and ``m`` of their full sets, ``i`` of the intersection, whether they are ``good`` enough, and what is ``added`` in a."""
    both = (pairs.join(full.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")
            .join(full.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b"))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {"a": batch.column(0), "b": batch.column(1), "n": [], "m": [], "i": [], "good": [], "added": []}
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            same = np.isin(x, y, assume_unique=True)
            out["n"].append(len(x))
            out["m"].append(len(y))
            out["i"].append(i := int(same.sum()))
            out["good"].append(100 * i >= rule.percent * (len(x) + len(y) - i))
            out["added"].append(x[~same].view(np.int64))
        return out

    return map_rows(both, run, "a long, b long, n long, m long, i long, good boolean, added array<long>", 8 << 20)


def _confirmed(pairs: DataFrame, full: DataFrame, rule: Rule) -> DataFrame:
    """Those ``a``, ``b`` of ``pairs`` whose full sets are similar enough."""
    return checkpointed(_compared(pairs, full, rule).filter("good").select("a", "b"))


def linked(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs``.

    The component is the smallest doc_id that links reach, itself included. Empty sets link with nothing, and so do rows without a
    doc_id, whose component is null and which are kept. Rows with the same doc_id are one document whose sets all link. An empty
    table gives an empty table; other columns are not looked at.
    """
    rows = checkpointed(posted(docs, rule))
    full_rows = rows.filter(F.col("digest").isNotNull())
    one = checkpointed(full_rows.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "postings")).alias("own"))
                       .select("digest", "own.*"))
    links = _links(docs, one, rule)
    same = full_rows.join(one.select("digest", F.col("doc_id").alias("b")), "digest").filter("doc_id > b").select(F.col("doc_id").alias("a"), "b")
    parts = components(links.unionByName(same))
    return (rows.select("doc_id", F.col("n").alias("n_shingles")).join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
                    F.coalesce(F.col("component").isNull(), F.lit(True)).alias("kept")))


def _links(docs: DataFrame, one: DataFrame, rule: Rule) -> DataFrame:
    """Enough confirmed links ``a``, ``b`` between different sets to join all that are similar."""
    m = rule.matches
    each = one.select("doc_id", "n", F.explode("postings").alias("post"))
    lists = checkpointed(each.groupBy("post").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"))
    own = Window.partitionBy("doc_id", "n")
    shared = checkpointed(
        each.join(lists, "post").withColumns({"s": F.count(F.lit(1)).over(own), "central": F.sum("f").over(own),
                                              "nth": F.row_number().over(own.orderBy("f", "post"))})
        .filter(F.col("s") >= m).withColumn("prefix", F.col("nth") <= F.col("s") - m + 1).drop("nth", "s", "f"))
    full = _full_sets(docs, one.join(shared.select("doc_id").distinct(), "doc_id").select("doc_id", "digest"), rule)
    posts = checkpointed(one.join(shared.select("doc_id").distinct(), "doc_id").select("doc_id", "n", "postings"))

    star = checkpointed(_compared(_colliding(checkpointed(_best(shared)), posts, rule, loose=True), full, rule))
    # near copies may have found different centres: members of a centre also meet the centre that it meets most often itself
    heads = checkpointed(star.select(F.col("b").alias("doc_id")).distinct())
    higher = checkpointed(_best(shared.join(heads, "doc_id")).select(F.col("a").alias("b"), F.col("b").alias("higher")))
    again = checkpointed(star.select("a", "b").join(higher, "b").filter("a != higher").select("a", F.col("higher").alias("b")).distinct())
    again = checkpointed(_compared(_colliding(again, posts, rule, loose=True), full, rule))
    met = checkpointed(star.withColumn("home", F.col("b")).unionByName(again.join(star.select("a", F.col("b").alias("home")), "a").select(*star.columns, "home")))
    found = checkpointed(met.filter("good").select("a", "b").distinct())
    part = components(found).withColumnRenamed("node", "doc_id")
    own_part = F.coalesce("component", "doc_id").alias("component")
    family = checkpointed(met.select(F.col("a").alias("doc_id"), F.col("b").alias("family"), "n", "m", "i", "good", "added", "home").join(part, "doc_id", "left")
                          .select("doc_id", "family", "home", "n", "m", "i", "good", "added", own_part))
    kin = met.groupBy(F.col("a").alias("doc_id")).agg(F.collect_set("b").alias("kin"))
    release_shuffles(docs.sparkSession)
    heads = checkpointed(shared.filter("prefix").select("doc_id", "n", "post").join(part, "doc_id", "left").join(kin, "doc_id", "left")
                         .select("doc_id", "n", "post", own_part, F.array_union(F.array("doc_id"), F.coalesce("kin", F.array().cast("array<long>"))).alias("kin")))
    pairs = _across(heads, rule).unionByName(_within(family, rule)).distinct()
    rest = _confirmed(_colliding(checkpointed(pairs), posts, rule), full, rule)
    return found.unionByName(rest)


def _best(shared: DataFrame) -> DataFrame:
    """Each document ``a`` and ``b``, of the most central documents of its lists the one that it meets most often."""
    centres = checkpointed(shared.groupBy("post").agg(F.max(F.struct("central", (-F.col("doc_id")).alias("centre"))).alias("top"))
                           .select("post", (-F.col("top.centre")).alias("centre")))
    return (shared.join(centres, "post").filter("doc_id != centre").groupBy("doc_id", "centre").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("doc_id").agg(F.max(F.struct("c", "centre")).alias("top")).select(F.col("doc_id").alias("a"), F.col("top.centre").alias("b")))


def _across(heads: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of a prefix list that are in different components and have met no centre in common: those outside the list's largest component against all."""
    main = (heads.groupBy("post", "component").agg(F.count(F.lit(1)).alias("c"), F.min("kin").alias("low"), F.max("kin").alias("high")).groupBy("post")
            .agg(F.max(F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"))
            .filter("parts > 1 AND low != high").select("post", F.col("top.component").alias("main")))
    prefixes = heads.groupBy("doc_id").agg(F.collect_set("post").alias("prefix"))
    open_ = checkpointed(heads.join(checkpointed(main), "post").join(prefixes, "doc_id"))
    other = open_.select("post", F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"), F.col("kin").alias("kin_b"),
                         F.col("prefix").alias("prefix_b"))
    # each pair once: in the first list that both have, and from one side
    once = ((F.col("other") == F.col("main")) | (F.col("a") > F.col("b"))) & (F.array_min(F.array_intersect("prefix", "prefix_b")) == F.col("post"))
    return (open_.filter("component != main").select("post", F.col("doc_id").alias("a"), "n", "component", "kin", "main", "prefix").join(other, "post")
            .filter((F.col("component") != F.col("other")) & ~F.arrays_overlap("kin", "kin_b") & _may_link("n", "m", rule) & once)
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _within(family: DataFrame, rule: Rule) -> DataFrame:
    """Pairs around one centre that are in different components and may be similar enough.

    What two members share is at most the smaller share that they have of the centre, and what was added to both. So they share enough
    additions, which are rare and make short lists, or both have enough of the centre, which takes a member smaller than the centre.
    """
    p = rule.percent
    enough = lambda k: (k + F.least("i_a", "i_b")) * (100 + p) >= (F.col("n_a") + F.col("n_b")) * p
    side = lambda df, x, *more: df.select("family", *more, *(F.col(c).alias(f"{n}_{x}") for c, n in (
        ("doc_id", "id"), ("n", "n"), ("i", "i"), ("component", "part"), ("home", "home"))))
    # members that share their first centre are paired there alone
    first = (F.col("home_a") != F.col("home_b")) | (F.col("family") == F.col("home_a"))
    added = family.select("family", "doc_id", "home", "n", "i", "component", F.explode("added").alias("x"))
    lists = added.groupBy("family", "x").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("f")).filter("low != high")
    own = Window.partitionBy("family", "doc_id")
    # so many additions a member lacks in any case; rare first, it shares one of the others with all that it can be similar to
    lacks = F.greatest(F.ceil(F.col("n") * p / 100) - F.col("i"), F.lit(1))
    added = checkpointed(added.join(lists.select("family", "x", "f"), ["family", "x"])
                         .withColumns({"nth": F.row_number().over(own.orderBy("f", "x")), "s": F.count(F.lit(1)).over(own)})
                         .filter(F.col("s") >= lacks).withColumn("prefix", F.col("nth") <= F.col("s") - lacks + 1))
    more = checkpointed(added.groupBy("family", "doc_id").agg(F.collect_set("x").alias("more")))
    head = added.filter("prefix")
    by_added = (side(head, "a", "x").join(side(head, "b", "x"), ["family", "x"])
                .filter((F.col("id_a") > F.col("id_b")) & (F.col("part_a") != F.col("part_b")) & first & _may_link("n_a", "n_b", rule))
                .drop("x").distinct()
                .join(more.select("family", F.col("doc_id").alias("id_a"), F.col("more").alias("more_a")), ["family", "id_a"])
                .join(more.select("family", F.col("doc_id").alias("id_b"), F.col("more").alias("more_b")), ["family", "id_b"])
                .filter(enough(F.size(F.array_intersect("more_a", "more_b")))))
    # sizes of linked sets lie in the same class or the next
    size = F.floor(F.log(F.col("n")) / float(np.log(100 / p) + 1e-9)).cast("int")
    small = side(family.filter("n < m").withColumn("size", size), "a", "size")
    loose = side(family.filter("NOT good").withColumn("size", F.explode(F.array(size - 1, size, size + 1))), "b", "size")
    by_centre = small.join(loose, ["family", "size"]).filter((F.col("id_a") != F.col("id_b")) & (F.col("part_a") != F.col("part_b")) & first & enough(F.lit(0)))
    return by_added.select("id_a", "id_b").unionByName(by_centre.select("id_a", "id_b")).select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b"))


def _colliding(pairs: DataFrame, posts: DataFrame, rule: Rule, loose: bool = False) -> DataFrame:
    """Those pairs that collide in at least ``matches`` coordinates and have fitting sizes; ``loose``: in half as many, of any sizes."""
    left = posts.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("postings").alias("p_a"))
    right = posts.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("postings").alias("p_b"))
    both = pairs.join(left, "a").join(right, "b")
    wanted = _collisions("p_a", "p_b") >= (max(1, rule.matches // 2) if loose else rule.matches)
    return checkpointed(both.filter(wanted if loose else _may_link("n_a", "n_b", rule) & wanted).select("a", "b").distinct())


def _full_sets(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id`` and its full ``set`` for those documents that have a candidate at all, kept as a table."""
    texts = join_small(documents(docs), checkpointed(wanted), ["doc_id"], 500_000).select("doc_id", "text", "digest")

    def run(batch: pa.RecordBatch) -> dict:
        own = sets(batch.column(1), rule.words)
        return {"doc_id": batch.column(0), "set": [s.tobytes() if digest(s) == d else None for s, d in zip(own, batch.column(2).to_pylist(), strict=True)]}

    folder = new_folder(docs.sparkSession, "sets")
    map_rows(texts, run, "doc_id long, set binary", 2 << 20).filter(F.col("set").isNotNull()).dropDuplicates(["doc_id"]).write.parquet(folder)
    return docs.sparkSession.read.schema("doc_id long, set binary").parquet(folder)


def distinct(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs``, all columns, without those that a component's smallest doc_id stands for.

    Null and empty texts, and rows without a doc_id, are all kept; rows with the same doc_id go or stay together. An empty table stays empty.
    """
    gone = checkpointed(linked(docs, rule).filter(~F.col("kept")).select("doc_id").distinct())
    small = gone.count() <= 500_000
    own = free_name(docs, "own_id")
    gone = gone.withColumnRenamed("doc_id", own)
    return docs.withColumn(own, F.col("doc_id").cast("long")).join(F.broadcast(gone) if small else gone, own, "left_anti").drop(own)
