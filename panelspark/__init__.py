"""Longitudinal cohort analytics as Spark DataFrame operators."""
