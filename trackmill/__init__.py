"""Trajectory analytics on Spark: DataFrame-to-DataFrame operators."""
