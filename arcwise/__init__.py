"""Path analytics on Spark: articulated chains, the paths they trace, and the geometry of those paths."""
