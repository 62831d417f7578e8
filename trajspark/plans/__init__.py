"""Whole plans: preprocessing, experiments and the registry of queries."""
