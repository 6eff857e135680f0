"""Pipelines from source tables to features, models and scenarios."""
