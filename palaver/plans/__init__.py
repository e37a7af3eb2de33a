"""Whole queries: features, reports and the end-to-end analysis."""
