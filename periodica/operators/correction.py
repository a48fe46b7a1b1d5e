"""Guarded corrections of a table: what depends on it is computed from both versions, and the new one goes live only if all changes lie in scope.

A table is a folder with `data/table_version=<n>/<column>=<epoch>/` and the manifests of `retention`, which name the live folders. A correction writes the
partitions that it touches as a new version and publishes a manifest with them in the old ones' places, which is one rename. A run that is lost before the rename changes
nothing; what it has written nobody reads. Replaced folders stay, so that the version before can be made live again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.operators.retention import _names, _publish, live, read
from periodica.sources.shared import shared_dir


def _folders(spark: SparkSession, path: str, version: str) -> list[str]:
    return [f"table_version={version}/{x}" for x in _names(spark, f"{path}/data/table_version={version}") if "=" in x]


def create(rows: DataFrame, path: str, by: str) -> None:
    """Writes the table's first version. Rows without an epoch are refused."""
    checked = rows.withColumn(by, F.coalesce(by, F.raise_error(F.lit("a row has no epoch")).cast(dict(rows.dtypes)[by])))
    checked.repartition(by).write.partitionBy(by).parquet(f"{path}/data/table_version=first")
    _publish(rows.sparkSession, path, _folders(rows.sparkSession, path, "first"))


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The live rows. The schema names the epoch column too."""
    return read(spark, path, schema).drop("table_version")


def differences(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two results that differ: keys (which may be null), was and now, each null where the row isn't there."""
    rest = [c for c in before.columns if c not in keys]
    a = before.select(F.struct(*keys).alias("k"), F.struct(*rest).alias("was"))
    b = after.select(F.struct(*keys).alias("l"), F.struct(*rest).alias("now"))
    same = reduce(lambda x, y: x & y, [F.col(f"k.{c}").eqNullSafe(F.col(f"l.{c}")) for c in keys])
    both = a.join(b, same & F.col("k").isNotNull() & F.col("l").isNotNull(), "full")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select(*[F.when(F.col("k").isNotNull(), F.col(f"k.{c}")).otherwise(F.col(f"l.{c}")).alias(c) for c in keys], "was", "now")


def correct(spark: SparkSession, path: str, schema: str, by: str, where: Column, values: dict[str, Column], dependants: Callable[[DataFrame], DataFrame], keys: list[str], scope: Column) -> DataFrame:
    """Sets values in the rows that meet `where`; returns the dependants' rows that this changes (keys, was, now).

    The dependants are computed from the table as it is and as it would be. A changed one outside the scope (null counts as outside) refuses the correction with ValueError, before anything is written.
    Only partitions with a changed row are written; if the new version then doesn't hold as many rows as the old one, the old one is made live again. A correction that changes no row writes nothing.
    The epoch itself can't be corrected.
    """
    if by in values:
        raise ValueError("the epoch can't be corrected")
    shared_dir(spark)
    was = live(spark, path)
    old = current(spark, path, schema)
    new = old.withColumns({c: F.when(where, v).otherwise(F.col(c)).cast(dict(old.dtypes)[c]) for c, v in values.items()})
    changes = differences(dependants(old), dependants(new), keys).checkpoint()
    outside = changes.where(~F.coalesce(scope, F.lit(False)))
    if not outside.isEmpty():
        raise ValueError(f"{outside.count()} dependants outside the scope would change")
    moved = reduce(lambda x, y: x | y, [~F.when(where, v).otherwise(F.col(c)).cast(dict(old.dtypes)[c]).eqNullSafe(F.col(c)) for c, v in values.items()])
    touched = sorted(r[0] for r in old.where(moved).select(by).distinct().collect())  # a row a partition
    if touched:
        version = uuid.uuid4().hex
        new.where(F.col(by).isin(touched)).repartition(by).write.partitionBy(by).parquet(f"{path}/data/table_version={version}")
        written = _folders(spark, path, version)
        replaced = {x.partition("/")[2] for x in written}
        before = old.count()
        _publish(spark, path, [x for x in was if x.partition("/")[2] not in replaced] + written)
        after = current(spark, path, schema).count()
        if after != before:
            _publish(spark, path, was)
            raise ValueError(f"{after} rows are there where {before} were")
    return changes
