"""Spark-native analytics for wildfire and land-cover data."""
