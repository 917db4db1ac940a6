"""A Spark-first engine that prepares and measures text and code corpora for language-model training."""
