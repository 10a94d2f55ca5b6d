"""Rating features, temporal splits, boosted-tree training and scoring as Spark DataFrame operators."""
