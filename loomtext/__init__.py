"""Spark-native engine that turns web pages and documents into clean, retrieval-ready context."""
