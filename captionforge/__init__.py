"""Subtitle-timeline analytics on Spark."""
