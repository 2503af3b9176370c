"""Table operators: catalog, statistics, hulls, tiles, pyramids, bands, rendering."""
