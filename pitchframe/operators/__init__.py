"""Table-to-table operators: each takes and returns Spark DataFrames."""
