"""Spark-native operators for turning scientific documents into tables."""
