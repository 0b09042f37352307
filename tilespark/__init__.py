"""tilespark: per-scale similarity search over image tiles, object-track analytics and their catalogue, on Spark."""
