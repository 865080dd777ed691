"""lodestone: a Spark-first engine for structural analytics over artifact tables."""
