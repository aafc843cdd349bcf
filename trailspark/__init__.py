"""Spark-native spatial point analytics and tour planning."""
