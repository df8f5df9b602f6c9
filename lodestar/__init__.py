"""Lodestar: DataFrame-to-DataFrame operators for analytics and text corpora on Spark."""
