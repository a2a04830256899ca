"""Spark-native graph analytics and corpus processing."""
