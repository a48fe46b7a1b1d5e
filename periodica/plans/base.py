"""What the registered queries read: the driver's tables, seen as events of entities, and the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL can express it, the DuckDB text for the same rows."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Order lines as events: entity is the supplier's nation, counterparty the customer's, epoch a year, period a month.

    Only the named columns (all without names), and only the tables that they need: a line's order, customer and
    supplier exist, so leaving one out loses no line. Amounts are whole cents, so sums don't depend on their order.
    """
    of_line = {
        "segment": F.col("l_orderkey"), "step": F.col("l_linenumber"), "kind": F.col("l_returnflag"), "status": F.col("l_linestatus"), "qty": F.col("l_quantity").cast("long"),
        "cents": F.round(F.col("l_extendedprice") * 100).cast("long"), "disc": F.round(F.col("l_discount") * 100).cast("int"), "supp": F.col("l_suppkey"), "part": F.col("l_partkey"),
    }
    of_order = {"epoch": F.year("o_orderdate"), "period": F.month("o_orderdate"), "cust": F.col("o_custkey")}
    of_customer, of_supplier = {"counterparty": F.col("c_nationkey")}, {"entity": F.col("s_nationkey")}
    every = of_line | of_order | of_customer | of_supplier
    wanted = columns or tuple(every)
    rows = table(spark, sf_dir, "lineitem")
    if {*wanted} & {*of_order, *of_customer}:
        rows = rows.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if {*wanted} & {*of_customer}:
        rows = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if {*wanted} & {*of_supplier}:
        rows = rows.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(*[every[c].alias(c) for c in wanted])


LINES = """lines AS (
  SELECT l_orderkey AS segment, l_linenumber AS step, s_nationkey AS entity, c_nationkey AS counterparty,
    CAST(year(o_orderdate) AS INTEGER) AS epoch, CAST(month(o_orderdate) AS INTEGER) AS period, l_returnflag AS kind, l_linestatus AS status,
    CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
    CAST(round(l_discount * 100) AS INTEGER) AS disc, l_suppkey AS supp, l_partkey AS part, o_custkey AS cust
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey)"""


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and day of the month: num is the value in hundredths, den the number of events; cohort is user_id % 5."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id", F.dayofmonth("ts").alias("period")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("num"), F.count("*").alias("den")).select("user_id", (F.col("user_id") % 5).alias("cohort"), "period", "num", "den")


USER_DAYS = """user_days AS (
  SELECT user_id, user_id % 5 AS cohort, CAST(dayofmonth(ts) AS INTEGER) AS period,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS num, count(*) AS den
  FROM events GROUP BY 1, 2, 3)"""
