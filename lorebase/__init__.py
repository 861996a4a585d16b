"""Spark-first analytics over stores of short texts, their vectors and links."""
