"""Exact quantiles by selection in two passes: no group's values meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.operators.upsert import null_safe
from periodica.sources.shared import shared_dir


def quantiles(rows: DataFrame, keys: list[str], value: str, at: list[float], weight: Column | None = None) -> DataFrame:
    """keys and q0, q1, ..: the exact quantiles of each group, with linear interpolation between neighbours. Rows count once, or weight times.

    Null values don't count, and a group without others has no row; a null key is a key. Equal values are added up first. They are then parted by ranges of
    key and value, and a range's count tells which wanted ranks lie in it: one row for a group and range. Only the ranges that
    hold a wanted rank are sorted, each in a task of its own, so a group with most of all rows is as many tasks as it has ranges.
    """
    shared_dir(rows.sparkSession)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg((F.count("*") if weight is None else F.sum(weight)).alias("_n"))
    ranged = counted.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()).checkpoint()
    group = Window.partitionBy(*keys)
    ranges = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_c"))
    ranges = ranges.withColumn("_before", F.sum("_c").over(group.orderBy("_part")) - F.col("_c")).withColumn("_total", F.sum("_c").over(group))
    wanted = []
    for i, q in enumerate(at):
        place = F.lit(q) * (F.col("_total") - 1)
        wanted += [F.struct(F.lit(i).alias("i"), F.lit(upper).alias("upper"), rank(place).alias("rank"), (place - F.floor(place)).alias("share")) for upper, rank in ((False, F.floor), (True, F.ceil))]
    here = F.filter(F.array(*wanted), lambda x: (x.rank >= F.col("_before")) & (x.rank < F.col("_before") + F.col("_c")))
    chosen = ranges.select(*keys, "_part", "_before", here.alias("_here")).where(F.size("_here") > 0)
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    placed = null_safe(ranged, chosen, [*keys, "_part"], "inner").withColumn("_to", upto)
    found = placed.select(*keys, "_v", F.explode(F.filter("_here", lambda x: (x.rank >= F.col("_to") - F.col("_n")) & (x.rank < F.col("_to")))).alias("x"))
    pick = lambda i, upper: F.max(F.when((F.col("x.i") == i) & (F.col("x.upper") == upper), F.col("_v")))
    share = lambda i: F.max(F.when(F.col("x.i") == i, F.col("x.share")))
    return found.groupBy(*keys).agg(*[(pick(i, False) + (pick(i, True) - pick(i, False)) * share(i)).alias(f"q{i}") for i in range(len(at))])
