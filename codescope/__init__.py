"""Spark-native code and text quality analytics."""
