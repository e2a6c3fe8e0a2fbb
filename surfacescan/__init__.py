"""Spark-native analytics over package execution surfaces and text corpora."""
