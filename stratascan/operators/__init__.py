"""Operators over frames and footer tables."""
