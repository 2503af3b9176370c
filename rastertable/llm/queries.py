"""All registered queries of this package; importing the modules registers them."""

from rastertable.llm import conversation_queries, dedup_queries, manifest_queries, mixing_queries, text_queries, warc_queries  # noqa: F401
from rastertable.llm.registry import ORACLES, QUERIES  # noqa: F401
