"""Administrative-geography analytics and training-data operators on Spark DataFrames."""
