"""Scalar functions as Spark Columns."""
