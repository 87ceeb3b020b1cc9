"""Cell-level error detection under differential dependencies, on Spark DataFrames."""
