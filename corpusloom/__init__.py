"""Corpus pre-flight analytics on Spark."""
