"""Brindle: a Spark-native engine for document analytics and retrieval."""
