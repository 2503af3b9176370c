"""Merkle manifest of a table: a digest of every row, a tree of 16 per source, and a proof for every leaf.

The place of a leaf is a rank query on a bitmap, so no table of leaves is ever sorted. Each source has a bitmap of its doc_ids, kept
as its non-zero 64-bit words (empty stretches take no room); words of one source from different tasks are merged by OR. A popcount directory
holds the rows before each word: sums inside 2^15 words, then inside 2^30, and so on, so that no step sees more than 2^15 entries
of a source together. A leaf then stands at the directory's count plus the bits below its own in its word.

Levels are reduced by keyed slot arrays: children go to (source, place / 16), where an array holds them by slot, and its digest is the next
level's node. Proofs run back down: each node's siblings are put before its parent's, so a run's 16 leaves share one path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertable.llm.tables import checkpointed, join_small

#: Children of a node, as bits of a place.
FAN_BITS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<l:string,r:string>>"


def digest(parts: Column) -> Column:
    """H of an array of strings."""
    return F.sha2(F.concat_ws("", parts).cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """H of values, each ``-`` if null, else the length in bytes of its text, a colon and its text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered_rows(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """``tree`` (the source; sorts as it does, null first), ``doc_id``, ``leaf`` and ``held``, the leaf after tampering (null where it is not tampered with)."""
    own = [F.col(c).cast("long") if c in ("doc_id", "n_chars") else F.col(c).cast("string") for c in FIELDS]
    return docs.select(
        F.coalesce(F.concat(F.lit("="), own[1]), F.lit("")).alias("tree"), own[0].alias("doc_id"), leaf_digest(*own).alias("leaf"),
        F.when(tampered_rows(own[0]), leaf_digest(*own[:4], lowered(own[4]))).alias("held"))


def preceding(counts: DataFrame, keys: list[str], code: str, n: str, then: str | None = None) -> DataFrame:
    """``counts`` with ``before``: the sum of ``n`` over the rows of the same ``keys`` with a smaller ``code`` (then ``then``).

    A directory by 15 bits of the code at a time: a window holds the entries of one parent only.
    """
    from pyspark.sql import Window

    def level(df: DataFrame, shift: int) -> DataFrame:
        over = [F.col(code)] + ([F.col(then)] if then and not shift else [])
        if shift >= 60:
            inside = Window.partitionBy(*keys).orderBy(*over)
            return df.withColumn("before", F.coalesce(F.sum(n).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        df = df.withColumn("up_", F.shiftright(code, 15))
        upper = level(df.groupBy(*keys, F.col("up_").alias(code)).agg(F.sum(n).alias(n)), shift + 15)
        inside = Window.partitionBy(*keys, "up_").orderBy(*over).rowsBetween(Window.unboundedPreceding, -1)
        mine = df.withColumn("mine_", F.coalesce(F.sum(n).over(inside), F.lit(0)))
        upper = upper.select(*keys, F.col(code).alias("up_"), F.col("before").alias("above_"))
        return mine.join(upper, [*keys, "up_"]).withColumn("before", F.col("mine_") + F.col("above_")).drop("up_", "mine_", "above_")

    return level(counts, 0)


def index(ids: DataFrame) -> DataFrame:
    """The bitmaps of all trees: ``tree``, ``word`` (doc_id / 64), ``bits``, ``again`` (slot and further rows of ids that several rows
    have) and ``before`` (rows of the tree in earlier words). Null ids are not in it."""
    counted = ids.filter("doc_id IS NOT NULL").groupBy("tree", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    slot = F.col("doc_id").bitwiseAND(F.lit(63)).cast("int")
    words = counted.groupBy("tree", F.shiftright("doc_id", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot)).alias("bits"), F.sum("n").alias("n"),
        F.collect_list(F.when(F.col("n") > 1, F.struct(slot.alias("slot"), (F.col("n") - 1).alias("more")))).alias("again"))
    return preceding(words, ["tree"], "word", "n").drop("n")


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (as ``leaves`` gives them) with ``place``, counted from 0 in each tree: null ids first, then by doc_id; rows of one id by leaf."""
    rows = checkpointed(rows)
    slot = F.col("doc_id").bitwiseAND(F.lit(63)).cast("int")
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), slot))
    nulls = rows.groupBy("tree").agg(F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"), F.count(F.lit(1)).alias("size"))
    found = rows.filter("doc_id IS NOT NULL").withColumn("word", F.shiftright("doc_id", 6)).join(index(rows), ["tree", "word"])
    ranked = found.select(
        "tree", "doc_id", "leaf", "held",
        (F.col("before") + F.bit_count(F.col("bits").bitwiseAND(below))
         + F.aggregate(F.filter("again", lambda x: x["slot"] < slot), F.lit(0).cast("long"), lambda s, x: s + x["more"])).alias("rank"),
        F.exists("again", lambda x: x["slot"] == slot).alias("several"))
    empty = rows.filter("doc_id IS NULL").select("tree", "doc_id", "leaf", "held", F.lit(0).cast("long").alias("rank"), F.lit(True).alias("several"))
    ranked = checkpointed(ranked.unionByName(empty))
    once = ranked.filter(~F.col("several")).drop("several")
    # rows that share an id: equal leaves are counted, then ordered by digest, a directory over its first 60 bits
    id_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_")
    same = ranked.filter("several").groupBy("tree", id_key, "leaf").agg(
        F.count(F.lit(1)).alias("n"), F.first("doc_id").alias("doc_id"), F.first("held").alias("held"), F.first("rank").alias("rank"))
    same = same.withColumn("code", F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long"))
    same = preceding(same, ["tree", "id_"], "code", "n", "leaf").select(
        "tree", "doc_id", "leaf", "held", F.col("rank"), F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)).alias("nth"))
    same = same.select("tree", "doc_id", "leaf", "held", (F.col("rank") + F.col("nth")).alias("rank"))
    every = join_small(once.unionByName(same), nulls, ["tree"])
    return every.select("tree", "doc_id", "leaf", "held", "size",
                        (F.col("rank") + F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("nulls"))).alias("place"))


def _slots(place: str, *more: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col(place).bitwiseAND(F.lit((1 << FAN_BITS) - 1)).cast("int").alias("slot"), *more))).alias("slots")


def _beside(slots: Column, k: Column, name: str) -> Column:
    """Siblings of slot ``k``: those to its left and to its right, each as one string."""
    names = F.transform(slots, lambda s: s[name])
    return F.struct(F.concat_ws("", F.slice(names, F.lit(1), k)).alias("l"),
                    F.concat_ws("", F.slice(names, k + 2, F.size(slots))).alias("r"))


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees over ``nodes`` (``tree``, ``place``, ``node``, ``size``: nodes of the tree on this level).

    Gives ``tree, top`` and, for every node, ``tree, place, steps``: what stands to the left and to the right of its way, from its own
    run up to the top.
    """
    levels = [nodes]
    while levels[-1].filter("size > 1").limit(1).count():
        up = levels[-1].filter("size > 1").groupBy("tree", F.shiftright("place", FAN_BITS).alias("place")).agg(
            _slots("place", "node"), F.ceil(F.max("size") / (1 << FAN_BITS)).cast("long").alias("size"))
        levels.append(checkpointed(up.withColumn("node", digest(F.transform("slots", lambda s: s["node"])))))
    tops = reduce(DataFrame.unionByName, [level.filter("size = 1").select("tree", F.col("node").alias("top")) for level in levels])
    alone = [level.filter("size = 1").select("tree", "place", F.array().cast(_STEPS).alias("steps")) for level in levels]
    paths = alone[-1]
    for level, done in zip(levels[:0:-1], alone[-2::-1], strict=True):
        down = level.join(paths, ["tree", "place"]).select("tree", "place", "slots", "steps", F.posexplode("slots").alias("k", "own"))
        down = down.select("tree", (F.shiftleft("place", FAN_BITS) + F.col("k")).alias("place"),
                           F.concat(F.array(_beside(F.col("slots"), F.col("k"), "node")), F.col("steps")).alias("steps"))
        paths = done.unionByName(down)
    return tops, paths


def numbered(df: DataFrame, by: str) -> DataFrame:
    """``df`` with ``place``, the number of each row in the order of ``by``: a range sort, then the rows of earlier partitions are added."""
    from pyspark.sql import Window

    ranged = checkpointed(df.orderBy(by).withColumn("at_", F.monotonically_increasing_id()))
    part = F.shiftright("at_", 33)
    # one row per partition
    sizes = ranged.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("n_"))
    earlier = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("from_"))
    return ranged.withColumn("part_", part).join(F.broadcast(earlier), "part_").withColumn(
        "place", F.col("from_") + F.col("at_") - F.shiftleft("part_", 33)).drop("part_", "at_", "from_")


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root, proof and the check of a tampered copy for every row.

    Columns read: doc_id, source, lang, n_chars, text; others are ignored, whatever their names. A null is written ``-`` in a leaf, an empty text
    ``0:``; texts of any length are hashed whole. Null sources are a tree of their own, the first one. Rows with a null doc_id come
    first in their source. Rows that share source and doc_id are leaves of their own, in the order of their digests; equal rows take
    neighbouring places. An empty table gives no rows.
    """
    at = placed(leaves(docs))
    runs = checkpointed(at.groupBy("tree", F.shiftright("place", FAN_BITS).alias("place")).agg(
        _slots("place", "doc_id", "leaf", "held"), F.max("size").alias("leaves")))
    names = F.transform("slots", lambda s: s["leaf"])
    nodes = runs.select("tree", "place", F.when(F.col("leaves") == 1, F.element_at(names, 1)).otherwise(digest(names)).alias("node"),
                        F.ceil(F.col("leaves") / (1 << FAN_BITS)).cast("long").alias("size"))
    subroots, paths = climb(nodes)
    subroots = checkpointed(subroots.withColumnRenamed("top", "subroot"))
    count = subroots.count()
    ordered = numbered(subroots, "tree").select(F.substring("tree", 1, 0).alias("tree"), F.col("tree").alias("source"), "subroot", "place",
                                                F.col("subroot").alias("node"), F.lit(count).cast("long").alias("size"))
    top, over = climb(ordered.select("tree", "place", "node", "size"))
    above = ordered.join(over, ["tree", "place"]).join(top, "tree").select(
        F.col("source").alias("tree"), "subroot", F.col("top").alias("root"), F.col("steps").alias("over"))
    whole = join_small(runs.join(paths, ["tree", "place"]), above, ["tree"])
    each = whole.select("subroot", "root", "slots", "leaves", F.concat("steps", "over").alias("steps"), F.posexplode("slots").alias("k", "own"))
    first = F.when(F.col("leaves") > 1, F.array(_beside(F.col("slots"), F.col("k"), "leaf"))).otherwise(F.array().cast(_STEPS))
    each = each.select(F.col("own.doc_id").alias("doc_id"), F.col("own.leaf").alias("leaf"), F.col("own.held").alias("held"), "subroot", "root",
                       F.concat(first, F.col("steps")).alias("steps"))
    proof = digest(F.transform("steps", lambda s: F.concat(s["l"], s["r"])))
    return each.select(
        "doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("held", "leaf"), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its way lead to."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]).cast("binary"), 256))
