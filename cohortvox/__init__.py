"""Volumetric-cohort analytics as Spark DataFrame operators."""
