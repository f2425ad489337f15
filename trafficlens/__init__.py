"""Network-threat analytics over traffic metadata, expressed as Spark DataFrames."""
