"""Retention on partitioned Parquet tables: a manifest names the live partitions, so that a deletion is one rename.

A table is a folder with `data/<column>=<epoch>/` and manifests `live-<version>.txt`, one line a live partition. Readers take the
highest version. A deletion counts what goes, writes the next manifest beside the table, moves it in place, counts what is
left through it, and only then removes the folders. A run that is lost before the move changes nothing; one that is lost after it leaves
folders that nobody reads, which the next run removes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    """The file system of a path and a maker of its paths."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, make = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(make(path))) if fs.exists(make(path)) else []


def _version(spark: SparkSession, path: str) -> int:
    return max((int(n[5:-4]) for n in _names(spark, path) if n.startswith("live-")), default=0)


def live(spark: SparkSession, path: str) -> list[str]:
    """The live partitions' folder names."""
    version = _version(spark, path)
    return sorted(r.value for r in spark.read.text(f"{path}/live-{version}.txt").collect()) if version else []  # a row a partition


def _publish(spark: SparkSession, path: str, folders: list[str]) -> None:
    fs, make = _fs(spark, path)
    beside, name = make(f"{path}/_next"), make(f"{path}/live-{_version(spark, path) + 1}.txt")
    out = fs.create(beside, True)
    out.write(bytearray("".join(f"{x}\n" for x in folders).encode()))
    out.close()
    if not fs.rename(beside, name):
        raise RuntimeError(f"{name} is there already: another run has changed the table")


def create(rows: DataFrame, path: str, by: str) -> None:
    """Writes the table's first version."""
    spark = rows.sparkSession
    rows.write.partitionBy(by).parquet(f"{path}/data")
    _publish(spark, path, [n for n in _names(spark, f"{path}/data") if "=" in n])


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the live partitions."""
    folders = [f"{path}/data/{x}" for x in live(spark, path)]
    reader = spark.read.schema(schema).option("basePath", f"{path}/data")
    return reader.parquet(*folders) if folders else spark.createDataFrame([], schema)


def apply(spark: SparkSession, path: str, schema: str, by: str, horizon: int) -> DataFrame:
    """Deletes the partitions before the horizon; returns the plan: epoch, rows, goes.

    Refused, with nothing changed: rows without an epoch, or a table that would be emptied. If what the new version holds isn't
    what the plan says, the version before is made live again and the run fails. A horizon before all epochs changes nothing.
    """
    was = live(spark, path)
    rows = read(spark, path, schema)
    plan = rows.groupBy(F.col(by).cast("int").alias("epoch")).agg(F.count("*").alias("rows"))
    counts = {r.epoch: r.rows for r in plan.collect()}  # a row a partition
    if None in counts:
        raise ValueError(f"{counts[None]} rows have no epoch")
    old = {e for e in counts if e < horizon}
    if old and len(old) == len(counts):
        raise ValueError("the table would be emptied")
    going = [x for x in was if x.partition("=")[2].lstrip("-").isdigit() and int(x.partition("=")[2]) < horizon]
    if going:
        _publish(spark, path, [x for x in was if x not in going])
        left, planned = read(spark, path, schema).count(), sum(n for e, n in counts.items() if e not in old)
        if left != planned:
            _publish(spark, path, was)
            raise ValueError(f"{left} rows are left where {planned} were planned")
    fs, make = _fs(spark, path)
    kept = set(live(spark, path))
    for name in _names(spark, f"{path}/data"):
        if "=" in name and name not in kept:
            fs.delete(make(f"{path}/data/{name}"), True)
    return spark.createDataFrame([(e, n, e in old) for e, n in sorted(counts.items())], "epoch int, rows long, goes boolean")
