"""Model preparation, training, evaluation and storage on Spark ML."""
