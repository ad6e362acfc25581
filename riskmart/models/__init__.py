"""Spark ML pipelines, the incremental training loop and importances."""
