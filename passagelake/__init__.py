"""passagelake: passage collections on Spark DataFrames."""
