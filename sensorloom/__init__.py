"""Sensor analytics on Spark: DataFrame operators and plans for building-sensor time series."""
