"""Trajectory analytics on Spark: DataFrame-to-DataFrame operators and declarative plans over them."""
