"""Volumetric analytics on Spark, with operators for training-data pipelines beside it."""
