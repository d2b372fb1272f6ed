"""Point clouds on Spark: levels of detail, octree nodes, neighbourhoods and blob tables."""
