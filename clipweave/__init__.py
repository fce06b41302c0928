"""clipweave: Spark jobs on timed media records (DataFrame in, DataFrame out)."""
