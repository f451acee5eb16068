"""A document and retrieval analytics engine expressed as Spark DataFrames."""
