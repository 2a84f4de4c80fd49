"""Spark-native analytics for road networks and the tables around them."""
