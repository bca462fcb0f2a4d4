"""Whole jobs: model pipelines and the query catalogue."""
