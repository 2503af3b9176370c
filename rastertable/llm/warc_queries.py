"""Archive query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rastertable.llm import warc
from rastertable.llm.registry import query
from rastertable.llm.tables import new_folder, read_table

WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""


@query("op6_warc", WARC_SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    manifest = warc.write(read_table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return warc.read(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
