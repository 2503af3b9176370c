"""Mixing query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rastertable.llm import mixing
from rastertable.llm.registry import query
from rastertable.llm.tables import read_table

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS name,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS h
  FROM documents),
sums AS (SELECT no_source, name, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL),
weighed AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY no_source, name) - 1) % 3 + 1 AS INT)] AS weight,
         CAST(sum(source_size) OVER () AS BIGINT) AS total, count(*) OVER () AS n
  FROM sums),
levels AS (
  SELECT *, (total * 1.5::DOUBLE - coalesce(CAST(sum(source_size * 2) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
            / CAST(sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS own_level
  FROM weighed WINDOW r AS (ORDER BY source_size * 2 / weight::DOUBLE, no_source, name)),
sources AS (
  SELECT *, least(CAST(source_size * 2 AS DOUBLE), weight * max(own_level) OVER ()) AS target, total * 1.5::DOUBLE AS budget,
         CAST(round(total * 1.5::DOUBLE / 32) AS BIGINT) AS blocks,
         CAST(greatest(1, ceil(source_size / greatest(10000.0::DOUBLE, total / 4096.0::DOUBLE))) AS BIGINT) AS shards
  FROM levels),
seats AS (
  SELECT no_source, name, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, no_source, name, k) AS place, blocks, target
  FROM sources, unnest(range(0, blocks + 1)) AS u(k)),
quotas AS (SELECT no_source, name, count(*) FILTER (place <= blocks AND target > 0) AS quota FROM seats GROUP BY ALL),
placed AS (
  SELECT z.*, ('0x' || substr(h, 1, 15))::BIGINT % s.shards AS shard FROM sized z JOIN sources s USING (no_source, name)),
per_shard AS (SELECT no_source, name, shard, CAST(sum(size) AS BIGINT) AS shard_size FROM placed GROUP BY ALL),
shard_seats AS (
  SELECT p.*, q.quota, k, row_number() OVER (PARTITION BY no_source, name ORDER BY shard_size / CAST(2 * k + 1 AS DOUBLE) DESC, shard, k) AS place
  FROM per_shard p JOIN quotas q USING (no_source, name), unnest(range(0, q.quota + 1)) AS u(k)),
shards AS (
  SELECT no_source, name, shard, shard_size, CAST(greatest(1, ceil(shard_size / 32.0::DOUBLE)) AS BIGINT) AS blocks,
         least(count(*) FILTER (place <= quota AND shard_size > 0), 2 * CAST(greatest(1, ceil(shard_size / 32.0::DOUBLE)) AS BIGINT)) AS seats,
         ('0x' || substr(md5('mix|' || name || '|' || shard), 1, 15))::BIGINT % CAST(greatest(1, ceil(shard_size / 32.0::DOUBLE)) AS BIGINT) AS start
  FROM shard_seats GROUP BY no_source, name, shard, shard_size),
stream AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY no_source, name, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS until FROM placed),
ends AS (
  SELECT t.*, s.blocks, s.seats // s.blocks AS every, s.seats % s.blocks AS extra, s.start, until // 32 AS j, (until - size) // 32 AS i
  FROM stream t JOIN shards s USING (no_source, name, shard)),
cut AS (
  SELECT *, (j * extra + start) // blocks AS jb, ((j + 1) * extra + start) // blocks AS ja,
         (i * extra + start) // blocks AS ib, ((i + 1) * extra + start) // blocks AS ia FROM ends)
SELECT c.doc_id, c.size, s.source_size, s.target,
       CAST(every * size + (jb * 32 + (ja - jb) * (until - j * 32)) - (ib * 32 + (ia - ib) * (until - size - i * 32)) AS BIGINT) AS taken
FROM cut c JOIN sources s USING (no_source, name)
"""


@query("op3_mixing", MIX_SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from every document."""
    return mixing.mixed(read_table(spark, sf_dir, "documents")).drop("source")
