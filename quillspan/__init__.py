"""Analytics over source corpora and training data, on Spark's DataFrame and SQL interfaces."""
