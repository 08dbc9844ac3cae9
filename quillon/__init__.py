"""quillon: a Spark-first engine for nearest-neighbour transaction scoring."""
