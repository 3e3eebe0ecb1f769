"""Spark-native maritime forensic analytics."""
