"""Spark-first analytics for how concentrated a population's dependencies are."""
