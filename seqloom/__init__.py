"""seqloom: sequence self- and cross-similarity with methylation overlays, on Spark DataFrames."""
