"""Whole products assembled from the operators."""
