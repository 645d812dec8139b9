"""Sensor time series at many stations, on Spark DataFrames, MLlib and Structured Streaming."""
