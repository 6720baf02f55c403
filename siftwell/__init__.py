"""FDR-controlled variable selection over Spark DataFrames."""
