"""Spark-first processing of structured analysis reports and the records around them."""
