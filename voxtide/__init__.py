"""Spark-native analytics over tables of social posts."""
