"""Distributed operators: keys and upserts, threads, timelines, quantiles, models."""
