"""Operators for training-data pipelines: one module per operator, their named queries in ``queries``."""
