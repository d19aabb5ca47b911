"""Evidence-timeline analytics on Spark DataFrames."""
