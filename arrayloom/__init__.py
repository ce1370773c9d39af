"""A Spark-native engine for vector, bit and matrix analytics over DataFrames."""
