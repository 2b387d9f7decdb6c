"""A Spark-first engine for tagged text and speech manifests."""
