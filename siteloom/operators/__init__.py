"""Table-level operators: DataFrames in, a DataFrame out."""
