"""All registered queries; importing the modules registers them."""

from rastertable.plans import (  # noqa: F401
    algebra_queries,
    catalog_queries,
    geo_queries,
    ingest_queries,
    render_queries,
    stats_queries,
    tile_queries,
)
from rastertable.plans.registry import ORACLES, QUERIES  # noqa: F401
