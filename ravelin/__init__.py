"""Spark-native temporal analytics: DataFrame-in, DataFrame-out operators."""
