"""Late facts: which stored periods depend on them, and those alone anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stored_form(facts: DataFrame, keys: list[str], period: str, sums: list[str]) -> DataFrame:
    """One row a key and period with its sums and, as to_<sum>, the running sums up to it. Null counts as nothing."""
    w = Window.partitionBy(*keys).orderBy(period)
    per = facts.groupBy(*keys, period).agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sums])
    return per.select(*keys, period, *sums, *[F.sum(s).over(w).alias(f"to_{s}") for s in sums])


def changed_by(stored: DataFrame, late: DataFrame, keys: list[str], period: str, sums: list[str]) -> DataFrame:
    """The rows to write after late facts (keys, period, sums): those that differ from what is stored, with an action (inserted, updated).

    A fact of a period reaches its key's periods from that one on. Those alone are computed again; the key's earlier periods come down to one carried row, and other keys
    are passed over by the join with the late ones. Late facts that come to nothing give no rows; those without a period are ignored. Keys may be null. Facts are summed
    by period first, so a key's window is as long as its periods, however many facts it has.
    """
    late = late.where(F.col(period).isNotNull()).groupBy(*keys, period).agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sums])
    since = late.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(period).alias("_since"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    near = stored.join(since, same).drop(*[f"_{k}" for k in keys])
    was = F.struct(*sums, *[f"to_{s}" for s in sums])
    # Rows before the first late period give one carried row; the rest keep what is stored beside their facts.
    old = near.select(*keys, F.when(F.col(period) >= F.col("_since"), F.col(period)).alias(period), F.col(period).alias("_at"), was.alias("_was"), *sums)
    every = old.unionByName(late, allowMissingColumns=True)
    per = every.groupBy(*keys, period).agg(*[F.sum(s).alias(s) for s in sums], F.max_by("_was", "_at").alias("_was"))
    w = Window.partitionBy(*keys).orderBy(F.col(period).asc_nulls_first())
    new = per.select(*keys, period, *sums, *[F.sum(s).over(w).alias(f"to_{s}") for s in sums], "_was").where(F.col(period).isNotNull())
    now = F.struct(*sums, *[f"to_{s}" for s in sums])
    return new.where(~now.eqNullSafe(F.col("_was"))).withColumn("action", F.when(F.col("_was").isNull(), "inserted").otherwise("updated")).drop("_was")


def merged(stored: DataFrame, changed: DataFrame, keys: list[str], period: str) -> DataFrame:
    """The stored rows with the changed ones in their places."""
    fresh = changed.select(*[F.col(c).alias(f"_{c}") for c in [*keys, period]])
    same = F.lit(True)
    for c in [*keys, period]:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return stored.join(fresh, same, "left_anti").unionByName(changed.select(*stored.columns))
