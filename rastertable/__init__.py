"""rastertable: raster catalogs, statistics, pyramids and tile layers as Spark jobs."""
