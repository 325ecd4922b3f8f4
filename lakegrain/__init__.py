"""A query dialect for scientific tables, on Spark DataFrames."""
