"""docspark: document analytics expressed as Spark DataFrames."""
