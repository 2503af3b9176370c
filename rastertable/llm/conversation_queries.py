"""Repair of conversations; SQL has no search for the cheapest edits, so tests hold it against a plain one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rastertable.llm import conversations
from rastertable.llm.registry import query
from rastertable.llm.tables import read_table


@query("op12_conversations")
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired digests of all conversations."""
    return conversations.repaired(read_table(spark, sf_dir, "conversations"))
