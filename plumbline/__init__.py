"""Spark-native evaluation analytics: every operator takes and returns DataFrames or Columns."""
