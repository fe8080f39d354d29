"""Topic modelling and corpus preparation on Spark DataFrames."""
