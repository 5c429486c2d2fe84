"""Spark-native engine for structured document analytics."""
