"""kinweave: record linkage and analytics over Spark DataFrames."""
