"""rankloom: deterministic candidate ranking and data preparation on Spark DataFrames."""
