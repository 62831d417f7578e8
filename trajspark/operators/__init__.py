"""Operators: DataFrame in, DataFrame out. None runs a job of its own, but for those that say so."""
