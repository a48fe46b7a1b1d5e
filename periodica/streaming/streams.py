"""Structured Streaming forms of the polled operators; each run reads what is there and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from periodica.operators import locks as L
from periodica.operators import state as ST
from periodica.sources.shared import shared_path


def stream_of(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """A Parquet file or a folder of them as a stream; the time column is given a zone, as watermarks need.

    The path goes in as a pattern of itself: a stream takes a single file only that way.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn(time, F.col(time).cast("timestamp"))


def run(rows: DataFrame, what: str) -> DataFrame:
    """Runs an append stream over what is available and returns the rows it wrote."""
    spark = rows.sparkSession
    out, state = shared_path(spark, what), shared_path(spark, f"{what}-state")
    rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def windowed(rows: DataFrame, time: str, keys: list[str], aggs: list, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling windows, or sliding ones with a slide; a window is given out when the watermark passes its end."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = rows.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c != "w"])


def sessions(rows: DataFrame, time: str, keys: list[str], aggs: list, gap: str, late: str = "10 minutes") -> DataFrame:
    out = rows.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c != "w"])


def deduplicated(rows: DataFrame, time: str, keys: list[str], late: str = "40 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def change_log(rows: DataFrame, key: str, order: str, tracked: str) -> DataFrame:
    """Runs the stream and returns the rows where the tracked field of a key isn't what was given out last.

    Each micro-batch is one window over its rows behind the last row of each key, which sorts on disk: no worker
    holds a key's rows, however many a batch has. The last rows are kept as a folder a batch; one given twice
    writes the same folders again.
    """
    spark, names = rows.sparkSession, [key, order, tracked]
    schema = rows.select(*names).schema
    out, top = shared_path(spark, "changes"), shared_path(spark, "changes-last")
    last: dict[int, str] = {}

    def fold(batch: DataFrame, number: int) -> None:
        new = batch.select(*names, F.lit(True).alias("_new"))
        if before := [n for n in last if n < number]:
            new = new.unionByName(spark.read.schema(schema).parquet(last[max(before)]).withColumn("_new", F.lit(False)))
        was = F.lag(tracked).over(Window.partitionBy(key).orderBy("_new", order))
        changed = new.withColumn("_was", was).where(F.col("_new") & ~F.col(tracked).eqNullSafe(F.col("_was")))
        changed.select(*names).write.mode("overwrite").parquet(f"{out}/batch={number}")
        newest = new.groupBy(key).agg(F.max(F.struct("_new", order, tracked)).alias("_last"))
        newest.select(key, F.col("_last")[order].alias(order), F.col("_last")[tracked].alias(tracked)).write.mode("overwrite").parquet(f"{top}/{number}")
        last[number] = f"{top}/{number}"

    upserting(rows, fold)
    return spark.read.schema(schema).parquet(*[f"{out}/batch={n}" for n in last]) if last else spark.createDataFrame([], schema)


def locks(runs: DataFrame, keys: list[str], lead: int, late: int = 600_000_000) -> DataFrame:
    """Runs the stream of (keys, start long, at long, id long) and returns its locks (keys, start, kind, id), as `operators.locks` defines them.

    A micro-batch is one grouping of its runs behind the earliest runs of the starts that are still open. A start is given out once, by the micro-batch whose newest
    run is more than `late` microseconds past it; starts not passed so far are still open. Runs that come behind the mark left by the micro-batch
    before are dropped, so a lock that was given out can't change. No start is a call of its own, as it is in `lock_timers`.
    """
    spark, names = runs.sparkSession, [*keys, "start"]
    kinds = dict(runs.dtypes)
    typed = ", ".join(f"`{k}` {kinds[k]}" for k in names)
    schema, open_schema = f"{typed}, kind string, id long", f"{typed}, first struct<at: long, id: long>"
    out, top = shared_path(spark, "locks"), shared_path(spark, "locks-open")
    marks: dict[int, int | None] = {}

    def fold(batch: DataFrame, number: int) -> None:
        before = max((n for n in marks if n < number), default=None)
        mark = None if before is None else marks[before]
        new = batch.select(*names, "at", "id").where("at is not null and start is not null")
        if mark is not None:
            new = new.where(F.col("at") >= mark)
        inside = (F.col("at") >= F.col("start") - lead * L.HOUR) & (F.col("at") < F.col("start"))
        first = new.where("at < start").select(*names, F.when(inside, F.struct("at", "id")).alias("first"))
        if before is not None:
            held = spark.read.schema(open_schema).parquet(f"{top}/{before}")
            first = first.unionByName(held if mark is None else held.where(F.col("start") >= mark))
        first.groupBy(*names).agg(F.min("first").alias("first")).write.mode("overwrite").parquet(f"{top}/{number}")
        newest = new.agg(F.max("at")).first()[0]  # one number
        marks[number] = mark if newest is None else max(newest - late, newest - late if mark is None else mark)
        known = spark.read.schema(open_schema).parquet(f"{top}/{number}")
        passed = known.where(F.col("start") < F.lit(marks[number]).cast("long"))
        given = passed.select(*names, F.when(F.col("first").isNull(), "missed").otherwise("locked").alias("kind"), F.col("first.id").alias("id"))
        given.unionByName(new.where("at >= start").select(*names, F.lit("rejected").alias("kind"), "id")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    upserting(runs, fold)
    return spark.read.schema(schema).parquet(*[f"{out}/batch={n}" for n in marks]) if marks else spark.createDataFrame([], schema)


def upserting(rows: DataFrame, merge: Callable[[DataFrame, int], None]) -> None:
    """Hands each micro-batch to a merge, which must bear being given one twice."""
    state = shared_path(rows.sparkSession, "upsert-state")
    rows.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


LOG = "src int, key long, poll int, action string, state string"
VERDICTS = "src int, poll int, size long, expected long, out boolean"


def guarded_log(polls: DataFrame, sticky: Column, folder: str, floor: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Runs the guarded log over the polls that have come since the last run, and returns the log and verdicts of all runs. folder (shared) keeps them and the state.

    polls is a stream of (src, key, poll, state). A micro-batch is one `guarded_step` behind the last sightings and counts that the one before it left,
    in folders by its number: one given twice writes the same folders again. A poll must come whole, in one micro-batch, and later than all
    earlier ones of its source; else the micro-batch fails before anything is written, since rows already told can't be taken back.
    """
    spark = polls.sparkSession
    schemas = {"log": LOG, "verdicts": VERDICTS, "held": ST.HELD, "counts": ST.COUNTS}
    path = lambda what, number: f"{folder}/{what}/batch={number}"
    for what, schema in schemas.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path(what, -1))

    def fold(batch: DataFrame, number: int) -> None:
        held, counts = (spark.read.schema(schemas[w]).parquet(path(w, number - 1)) for w in ("held", "counts"))
        new = batch.select("src", "key", "poll", "state").checkpoint()
        late = new.groupBy("src").agg(F.min("poll").alias("oldest")).join(counts, "src").where("oldest <= newest").orderBy("src").first()
        if late is not None:
            raise ValueError(f"source {late.src} has poll {late.oldest} behind poll {late.newest}")
        for what, rows in zip(schemas, ST.guarded_step(new, sticky, held, counts, floor), strict=True):
            rows.write.mode("overwrite").parquet(path(what, number))

    polls.writeStream.foreachBatch(fold).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    log, verdicts = (spark.read.schema(schemas[w]).parquet(f"{folder}/{w}").drop("batch") for w in ("log", "verdicts"))
    return log, verdicts
