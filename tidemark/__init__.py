"""Segmentation of noisy clock readings, and training-data operators, on Spark."""
