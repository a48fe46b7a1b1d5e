"""Queries: the stream forms, run over what the events table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.operators.upsert import last_wins
from periodica.plans.base import SQL, query, table
from periodica.plans.feeds import _states
from periodica.sources.shared import shared_path
from periodica.streaming import streams as S


def _events(spark: SparkSession, d: str) -> DataFrame:
    return S.stream_of(spark, f"{d}/events.parquet")


_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query(
    "op_ST7_stream_tumbling",
    f"""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS s, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT epoch_us(s) AS start_us, event_type, n FROM w WHERE s + INTERVAL 6 HOUR <= {_CLOSED}""",
)
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    """ST7, ST9: six-hour windows that the watermark has closed."""
    w = S.windowed(_events(spark, d), "ts", ["event_type"], [F.count("*").alias("n")], "6 hours")
    return S.run(w, "tumbling").select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query(
    "op_ST7_stream_sliding",
    f"""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS s FROM events, (SELECT unnest(range(0, 4)) AS k)) SELECT epoch_us(s) AS start_us, count(*) AS n FROM w WHERE s + INTERVAL 24 HOUR <= {_CLOSED} GROUP BY s""",
)
def sliding(spark: SparkSession, d: str) -> DataFrame:
    """ST7: a day's window every six hours."""
    w = S.windowed(_events(spark, d), "ts", [], [F.count("*").alias("n")], "24 hours", "6 hours")
    return S.run(w, "sliding").select(F.unix_micros("start").alias("start_us"), "n")


@query(
    "op_ST9_stream_sessions",
    f"""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l)
    SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM g GROUP BY user_id, sid HAVING max(ts) + INTERVAL 12 HOUR <= {_CLOSED}""",
)
def sessions(spark: SparkSession, d: str) -> DataFrame:
    """ST9: sessions of a user with a twelve-hour gap."""
    s = S.sessions(_events(spark, d), "ts", ["user_id"], [F.count("*").alias("n")], "12 hours")
    return S.run(s, "sessions").select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("op_ST11_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def dedupe(spark: SparkSession, d: str) -> DataFrame:
    """ST11: one row a key within the watermark."""
    e = _events(spark, d).select("user_id", "event_type", "ts")
    return S.run(S.deduplicated(e, "ts", ["user_id", "event_type"]), "dedupe").select("user_id", "event_type")


@query(
    "op_ST1_stream_change_log",
    """WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, event_type FROM l WHERE event_type IS DISTINCT FROM was""",
)
def change_log(spark: SparkSession, d: str) -> DataFrame:
    """ST1: the change-log as a stream that keeps a last row a key."""
    return S.change_log(_events(spark, d), "user_id", "event_id", "event_type")


@query("op_ST9_stream_upsert", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    """ST9, SK2: each micro-batch merged into the table of latest rows; every version is a new folder."""
    versions: list[str] = []
    schema = table(spark, d, "events").select("user_id", "event_type", "event_id").schema

    def merge(batch: DataFrame, _: int) -> None:
        rows = batch.select(*schema.names)
        if versions:
            rows = rows.unionByName(spark.read.schema(schema).parquet(versions[-1]))
        path = S.shared_path(spark, "latest")
        last_wins(rows.withColumn("seq", F.col("event_id")), ["user_id"], "seq").select(*schema.names).write.parquet(path)
        versions.append(path)

    S.upserting(_events(spark, d).select(*schema.names), merge)
    return spark.read.schema(schema).parquet(versions[-1]) if versions else spark.createDataFrame([], schema)


@query("op_ST2_ST4_stream_guarded_log", SQL["op_ST2_ST4_guarded_log"])
def stream_guarded_log(spark: SparkSession, d: str) -> DataFrame:
    """ST1, ST2, ST3, ST4: the guarded log as a stream; its polls arrive in three spans of time, each taken up by a run of its own behind the state of the one before."""
    incoming, folder = shared_path(spark, "polls"), shared_path(spark, "guarded")
    states = _states(spark, d)
    span = states.agg(F.struct(F.min("poll").alias("a"), (F.max("poll") + 1).alias("b"))).scalar()
    states = states.withColumn("third", F.floor(3 * (F.col("poll") - span.getField("a")) / (span.getField("b") - span.getField("a")))).checkpoint()
    for third in range(3):
        states.where(F.col("third") == third).drop("third").write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(states.drop("third").schema).parquet(incoming)
        log, _ = S.guarded_log(stream, F.col("state") == "purchase", folder)
    return log.withColumnRenamed("key", "user_id")
