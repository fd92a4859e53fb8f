"""Duplicate and near-duplicate analytics as Spark jobs."""
