"""Spark jobs for a marketplace catalogue with images and for training-data corpora."""
