"""Spark-first analytics over code graphs and text corpora."""
