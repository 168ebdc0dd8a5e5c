"""Search, merge, joins, statistics, ingest and raster jobs."""
