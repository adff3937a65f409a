"""Spark-native corpus preparation: DataFrame in, DataFrame out."""
