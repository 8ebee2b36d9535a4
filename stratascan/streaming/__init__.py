"""Batch-at-a-time reading."""
