"""Feeds and pages as DataFrames."""
