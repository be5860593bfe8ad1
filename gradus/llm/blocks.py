"""Sizes of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, saved


def large_groups(df: DataFrame, key: str, most: int) -> DataFrame:
    """Keys with more than `most` rows, counted and broadcast only if few."""
    return broadcast_if_small(saved(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most), "large-groups"))
