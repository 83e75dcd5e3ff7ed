"""Spark-native price-panel and changepoint analytics."""
