"""Event histories in, model-ready sequences out, as lazy Spark DataFrames."""
