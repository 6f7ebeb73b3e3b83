"""Multi-vector similarity search and the data processing around it, on DataFrames."""
