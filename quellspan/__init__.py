"""Spark-native detection of secrets and personal data in tables of text."""
