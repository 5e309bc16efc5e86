"""Continuous form of the row-wise stages."""
