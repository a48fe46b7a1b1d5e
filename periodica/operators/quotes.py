"""Consensus and movement of quoted lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def consensus(quotes: DataFrame, keys: list[str], point: str) -> DataFrame:
    """Median, range (null for one quoter) and number of quoters."""
    g = quotes.where(F.col(point).isNotNull()).groupBy(*keys)
    return g.agg(F.median(point).alias("middle"), F.when(F.count("*") >= 2, F.max(point) - F.min(point)).alias("spread"), F.count("*").alias("quoters"), F.min(point).alias("low"), F.max(point).alias("high"))


def straddles(keys: list[float]) -> Column:
    """Whether quoters stand on both sides of a key, or one on it and one off it."""
    each = [(F.col("low") <= float(k)) & (F.col("high") >= float(k)) & (F.col("low") != F.col("high")) for k in keys]
    out = each[0]
    for e in each[1:]:
        out = out | e
    return out


def movement(captures: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """First and last value by time; a move only where the two captures differ."""
    g = captures.groupBy(key).agg(F.min_by(value, at).alias("open"), F.max_by(value, at).alias("current"), F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("captures"))
    return g.select(key, "open", "current", "captures", F.when(F.col("a") != F.col("b"), F.col("current") - F.col("open")).alias("move"))
