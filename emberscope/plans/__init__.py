"""Whole analyses assembled from operators."""
