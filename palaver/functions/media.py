"""Expressions over the nested media arrays of a post."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stream_uri(media_type: Column, media: Column) -> Column:
    """URI of the first ``stream`` variant of a video; null for anything else."""
    variants = F.flatten(
        F.transform(media, lambda m: F.coalesce(m["variants"], F.array().cast(
            "array<struct<version:string,uri:string>>")))
    )
    streams = F.filter(variants, lambda v: v["version"] == "stream")
    return F.when(media_type == "VIDEO", F.get(streams, F.lit(0))["uri"])
