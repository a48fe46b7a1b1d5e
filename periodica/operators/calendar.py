"""Zones, capture calendars and the settlement of targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_day(instant: Column, zone: str) -> Column:
    """Calendar day of a UTC instant in a zone."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def utc_of(day: Column, clock: Column, zone: Column | str) -> Column:
    """UTC instant of a local day and "HH:MM", with daylight saving."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", day.cast("string"), clock), "yyyy-MM-dd HH:mm"), zone)


def zone_hours(instant: Column, zone_a: str, zone_b: str) -> Column:
    """Hours that zone b is ahead of zone a at an instant."""
    micros = F.unix_micros(F.from_utc_timestamp(instant, zone_b)) - F.unix_micros(F.from_utc_timestamp(instant, zone_a))
    return micros / 3.6e9


def lead_windows(matches: DataFrame, key: str, start: str, leads: list[tuple[int, int]]) -> DataFrame:
    """Non-overlapping capture windows [start - from, start - to) in hours before each match."""
    rows = F.array(*[F.struct(F.lit(f"h{a}").alias("target"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in leads])
    t = matches.select(key, start, F.explode(rows).alias("w"))
    hours = lambda c: F.make_dt_interval(hours=c)
    return t.select(key, "w.target", (F.col(start) - hours(F.col("w.a"))).alias("opens"), (F.col(start) - hours(F.col("w.b"))).alias("closes"))


def settle(targets: DataFrame, captures: DataFrame, key: str, at: str, cap: int) -> DataFrame:
    """Status of each target: captured by the first capture inside it, within a cap per key by opening order, else missed.

    Captures and targets meet on the key; a key's targets are few.
    """
    hits = targets.join(captures.select(key, F.col(at).alias("hit")), key).where((F.col("hit") >= F.col("opens")) & (F.col("hit") < F.col("closes")))
    first = hits.groupBy(key, "target").agg(F.min("hit").alias("captured_at"))
    out = targets.join(first, [key, "target"], "left")
    used = F.sum(F.col("captured_at").isNotNull().cast("int")).over(Window.partitionBy(key).orderBy("opens", "target"))
    status = F.when(F.col("captured_at").isNull(), "missed_deadline").when(used > cap, "missed_cap").otherwise("captured")
    return out.withColumn("status", status)
