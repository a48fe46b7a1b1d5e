"""The run ledger: one line for each run of a job, with what the running job itself counted."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LEDGER = "job string, status string, reason string, rows long, seconds double, digest string, at timestamp"


def entries(spark: SparkSession, path: str) -> DataFrame:
    """All lines of the ledger; none before its first run."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except PySparkException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def digest(rows: DataFrame) -> str:
    """What a job's input holds, whatever its order: the number of rows, and two combinations of their hashes."""
    h = F.xxhash64(*[F.col(c) for c in rows.columns])
    r = rows.select(h.alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return f"{r.n}:{r.s}:{r.x}"


def run_job(path: str, job: str, rows: DataFrame, write: Callable[[DataFrame], None]) -> str:
    """Runs write(rows) unless there is nothing to do, and adds the line; returns the status.

    Skipped without input ("no input"), or if the input is that of the job's last success ("unchanged"). A run that
    raises an error is "failed", with the error's condition as the reason. Rows are observed in the written plan: they are counted
    by the tasks that write, not by another pass.
    """
    spark, began = rows.sparkSession, time.monotonic()
    now = digest(rows)
    last = entries(spark, path).where((F.col("job") == job) & (F.col("status") == "success")).agg(F.max_by("digest", "at").alias("digest")).first().digest
    status, reason, count = "success", None, 0
    if now.startswith("0:"):
        status, reason = "skipped", "no input"
    elif now == last:
        status, reason = "skipped", "unchanged"
    else:
        seen = Observation()
        try:
            write(rows.observe(seen, F.count(F.lit(1)).alias("rows")))
            count = seen.get["rows"]
        except PySparkException as e:
            status, reason = "failed", e.getCondition() or type(e).__name__
    line = spark.createDataFrame([(job, status, reason, count, time.monotonic() - began, now)], "job string, status string, reason string, rows long, seconds double, digest string")
    line.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)
    return status
