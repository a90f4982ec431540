"""Operators of a training-data pipeline, each a Spark job; ``queries`` registers them with the SQL they are checked against."""
