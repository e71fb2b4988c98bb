"""Spark-native analytics of device fleets."""
