"""Shared distributed patterns: order statistics and interval joins without single-task windows."""
