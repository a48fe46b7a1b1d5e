"""The registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from periodica.plans import audits, capture, feeds, models, more, ratings, rollups, streams, tables, windows  # noqa: F401
from periodica.plans.base import QUERIES, SQL  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["op_M1_flagship_percentiles"](spark, sf_dir)
