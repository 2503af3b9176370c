"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources share a budget of words by weight, none above a multiple of its own size. The budget is cut into
blocks of equally many words, and the blocks go to the sources by highest quotients (target / 1, 3, 5, ...). A source
lies in shards of about equal size, so a hot source has more of them; its blocks go to its shards in the same way,
which gives each shard an integer quota. A shard's documents in a seeded order form a stream of blocks: every
block is taken ``quota // blocks`` times, and evenly spaced ones from a seeded start once more.

Nothing here counts quotients or blocks one by one: seats that are beyond doubt are granted at once, and what a
document gets follows from where its words begin and end in the stream. All of it is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertable.llm.tables import checkpointed, free_name, join_small

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Weights go to the sources by name, null last, over and over; ``share`` of all words is the budget, ``most`` the multiple of
    its size that a source may reach. Shards hold about ``shard_words``, or more where that would make over ``shards`` of them."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    block: int = 32
    shard_words: int = 10_000
    shards: int = 4096
    seed: str = "mix"


def hashed(seed: str, *cols: Column) -> Column:
    """A hexadecimal digest of the columns; nulls count as such."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("-")) for c in cols)))


def number(digest: Column) -> Column:
    """The first 60 bits of a digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """Per source (``no_source``, ``name``, ``source_size``): weight and target. One row per source is sorted in one task."""
    by_name, everything = Window.orderBy("no_source", "name"), Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "no_source", "name")
    cap = F.col("source_size") * mix.most
    weighed = (sizes
               .withColumn("weight", F.element_at(F.array(*map(F.lit, mix.weights)), ((F.row_number().over(by_name) - 1) % len(mix.weights) + 1).cast("int")))
               .withColumn("total", F.sum("source_size").over(everything))
               .withColumn("n", F.count(F.lit(1)).over(everything))
               .withColumn("ratio", cap / F.col("weight"))
               .withColumn("budget", F.least(F.col("total") * F.lit(mix.share), F.col("total") * F.lit(float(mix.most)))))
    before = F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # filling sources in the order of their limits: the level rises until the first source that stays below its limit
    return (weighed.withColumn("level", (F.col("budget") - before) / rest)
            .withColumn("level", F.max("level").over(everything))
            .withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.col("level"))))


def apportion(df: DataFrame, by: list[str], order: list[str], weight: str, seats: str, total: str, parts: str, name: str) -> DataFrame:
    """Sainte-Lague: adds ``name``, the seats of each row; ``seats``, ``total`` (of weights) and ``parts`` (rows) are those of its group.

    A row's seats differ from its proportional share by less than its part of the roundings of all rows, so only the
    seats within that distance are ranked; there are a few of them per row. Ties go by ``order``.
    """
    share = F.when(F.col(total) > 0, F.col(seats) * (F.col(weight) / F.col(total))).otherwise(0.0)
    around = F.ceil(1.5 * F.col(parts) * F.when(F.col(total) > 0, F.col(weight) / F.col(total)).otherwise(0.0)) + 2
    at = df.withColumn("sure", F.greatest(F.lit(0), F.floor(share) - around).cast("long")).withColumn("upto", (F.floor(share) + around).cast("long"))
    at = at.withColumn("open", F.col(seats) - F.sum("sure").over(Window.partitionBy(*by)))
    ranked = (at.withColumn("seat", F.explode(F.sequence("sure", "upto")))
              .withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.col(weight) / (2 * F.col("seat") + 1)), *order, "seat"))))
    won = F.count(F.when((F.col("place") <= F.col("open")) & (F.col(weight) > 0), 1))
    keep = [c for c in df.columns if c not in {*by, *order}]
    return (ranked.groupBy(*by, *order).agg(*(F.first(c).alias(c) for c in keep), (F.first("sure") + won).alias(name)))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted) of every row of ``docs``.

    Null and empty texts have size 0 and nothing taken; a null source is a source, the last one. Rows that are alike in
    doc_id and size are interchangeable; null doc_ids count as equal. Other columns are not looked at.
    """
    sized = checkpointed(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    sources = targets(sized.groupBy("no_source", "name").agg(F.sum("size").alias("source_size")), mix)
    sources = (sources.withColumn("blocks", F.round(F.col("budget") / mix.block).cast("long"))
               .withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(float(mix.shard_words)), F.col("total") / mix.shards))).cast("long"))
               .select("no_source", "name", "source_size", "target", "budget", "blocks", "n", "shards", F.lit(0).alias("all")))
    sources = checkpointed(apportion(sources, ["all"], ["no_source", "name"], "target", "blocks", "budget", "n", "quota"))
    key = ["no_source", "name"]
    placed = (join_small(sized, sources.select(*key, "shards"), key)
              .withColumn("h", hashed(mix.seed, F.col("doc_id"))).withColumn("shard", number(F.col("h")) % F.col("shards")).drop("shards"))
    per_shard = placed.groupBy(*key, "shard").agg(F.sum("size").alias("shard_size"))
    per_shard = (per_shard.join(sources.select(*key, "source_size", "target", "quota"), key)
                 .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*key))))
    shards = (apportion(per_shard, key, ["shard"], "shard_size", "quota", "source_size", "n", "seats")
              .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("shard_size") / mix.block)).cast("long"))
              .withColumn("seats", F.least("seats", F.col("blocks") * mix.most))
              .withColumn("every", F.floor(F.col("seats") / F.col("blocks"))).withColumn("extra", F.col("seats") % F.col("blocks"))
              .withColumn("start", number(hashed(mix.seed, F.col("name"), F.col("shard"))) % F.col("blocks"))
              .select(*key, "shard", "source_size", "target", "blocks", "every", "extra", "start"))
    order = Window.partitionBy(*key, "shard").orderBy("h", "doc_id", "size")
    at = placed.withColumn("until", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    def chosen_before(x: Column) -> Column:
        """Words before ``x`` in the stream that lie in blocks taken once more."""
        j = F.floor(x / mix.block)
        before = F.floor((j * F.col("extra") + F.col("start")) / F.col("blocks"))
        after = F.floor(((j + 1) * F.col("extra") + F.col("start")) / F.col("blocks"))
        return before * mix.block + (after - before) * (x - j * mix.block)

    taken = F.col("every") * F.col("size") + chosen_before(F.col("until")) - chosen_before(F.col("until") - F.col("size"))
    return at.join(shards, [*key, "shard"]).select(
        "doc_id", F.when(~F.col("no_source"), F.col("name")).alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"))


def resampled(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them: whole texts, a part of a text by a seeded draw.

    Rows with the same doc_id are taken equally often. Rows without words (null and empty texts too) are not taken; a null source mixes as a source
    of its own; an empty table stays empty. Further columns may have any names.
    """
    own, copies, copy = (free_name(docs, n) for n in ("own_id", "copies", "copy"))
    share = F.coalesce(F.try_divide(F.sum("taken"), F.sum("size")), F.lit(0.0))
    draw = number(hashed(mix.seed + " copies", F.col("doc_id"))) / float(1 << 60)
    taken = (mixed(docs, mix).groupBy("doc_id").agg(share.alias("share"))
             .select(F.col("doc_id").alias(own), (F.floor("share") + (draw < F.col("share") - F.floor("share")).cast("int")).alias(copies))
             .filter(F.col(copies) > 0))
    rows = docs.join(taken, docs["doc_id"].cast("long").eqNullSafe(taken[own]))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies).cast("long")))).select(*docs.columns)
