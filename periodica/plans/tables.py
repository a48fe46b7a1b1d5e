"""Queries: table maintenance, audits, sets, views, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from periodica.operators import quality as Q
from periodica.operators import upsert as U
from periodica.plans.base import LINES, lines, query, table
from periodica.sources import readers

_VERSIONS = """old AS (SELECT c_custkey, c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, c_mktsegment FROM customer WHERE c_custkey % 11 <> 0),
new AS (SELECT c_custkey, c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) + CASE WHEN c_custkey % 5 = 0 THEN 7 ELSE 0 END AS cents, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 7 <> 0)"""


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the customers: rows gone, added, changed and emptied."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"), "c_mktsegment")
    k = F.col("c_custkey")
    new = c.where(k % 7 != 0).withColumns({"cents": F.col("cents") + F.when(k % 5 == 0, 7).otherwise(0), "c_mktsegment": F.when(k % 13 != 0, F.col("c_mktsegment"))})
    return c.where(k % 11 != 0), new


@query(
    "op_SK1_content_hash",
    """SELECT o_orderkey, sha256('o_custkey=' || length(o_custkey::VARCHAR) || ':' || o_custkey || '|o_orderpriority=' || length(o_orderpriority::VARCHAR) || ':' || o_orderpriority || '|o_orderstatus=' || length(o_orderstatus::VARCHAR) || ':' || o_orderstatus) AS content_hash FROM orders""",
)
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """SK1: sha256 over sorted name=value pairs."""
    return table(spark, d, "orders").select("o_orderkey", U.content_hash(["o_orderstatus", "o_custkey", "o_orderpriority"]).alias("content_hash"))


@query(
    "op_SK2_upsert_actions",
    f"""WITH {_VERSIONS} SELECT c_custkey, CASE WHEN o.c_nationkey IS NULL THEN 'insert' WHEN n.c_nationkey IS NULL THEN 'keep' WHEN o.cents = n.cents AND o.c_mktsegment IS NOT DISTINCT FROM n.c_mktsegment AND o.c_nationkey = n.c_nationkey THEN 'same' ELSE 'update' END AS action FROM old o FULL JOIN new n USING (c_custkey)""",
)
def upsert_actions(spark: SparkSession, d: str) -> DataFrame:
    """SK2: insert, update, same or keep by content hash."""
    old, new = _versions(spark, d)
    return U.classify(old, new, ["c_custkey"])


@query(
    "op_SK2_merged_table",
    f"""WITH {_VERSIONS} SELECT c_custkey, coalesce(n.c_nationkey, o.c_nationkey) AS c_nationkey, CASE WHEN n.c_nationkey IS NULL THEN o.cents ELSE n.cents END AS cents, coalesce(o.c_mktsegment, n.c_mktsegment) AS c_mktsegment FROM old o FULL JOIN new n USING (c_custkey)""",
)
def merged_table(spark: SparkSession, d: str) -> DataFrame:
    """SK2, SK4: the table after the upsert; one column keeps its first value."""
    old, new = _versions(spark, d)
    return U.merged(old, new, ["c_custkey"], ("c_mktsegment",))


@query("op_SK3_last_wins", "SELECT l_orderkey, l_linenumber, arg_max(l_partkey, (l_shipdate, l_partkey, l_suppkey, l_quantity)) AS l_partkey, count(*) AS copies FROM lineitem GROUP BY ALL")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    """SK3: duplicate keys of a batch, last in sequence kept, copies counted."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity").alias("seq"))
    return U.last_wins(rows, ["l_orderkey", "l_linenumber"], "seq").drop("seq")


@query("op_SK5_scoped_delete", f"WITH {_VERSIONS} SELECT c_custkey, cents FROM old WHERE NOT (c_nationkey < 10) OR c_custkey IN (SELECT c_custkey FROM new)")
def scoped_delete(spark: SparkSession, d: str) -> DataFrame:
    """SK5: rows in scope that the run didn't make again go; others stay."""
    old, new = _versions(spark, d)
    return U.without_stale(old, new, ["c_custkey"], F.col("c_nationkey") < 10).select("c_custkey", "cents")


@query("op_SK6_mirror", f"WITH {_VERSIONS} SELECT c_custkey, cents, c_nationkey FROM old WHERE c_nationkey BETWEEN 10 AND 14 UNION ALL SELECT c_custkey, cents, c_nationkey FROM new WHERE c_nationkey < 10")
def mirror(spark: SparkSession, d: str) -> DataFrame:
    """SK6: good sources are mirrored, failed ones kept, unlisted ones taken down."""
    old, new = _versions(spark, d)
    status = table(spark, d, "nation").where("n_nationkey < 15").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") < 10).alias("ok"))
    return U.mirrored(old, new, status, "c_nationkey").select("c_custkey", "cents", "c_nationkey")


@query("op_SK7_insert_once", f"WITH {_VERSIONS} SELECT c_custkey, cents FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM old)")
def insert_once(spark: SparkSession, d: str) -> DataFrame:
    """SK7, SK8: what the ledger lacks."""
    old, new = _versions(spark, d)
    return U.insert_once(old, new, ["c_custkey"]).select("c_custkey", "cents")


@query(
    "op_SK9_due_datasets",
    """WITH live AS (SELECT n_regionkey AS dataset, n_nationkey AS source, 'v' || (n_nationkey % 4) AS marker FROM nation), stored AS (SELECT n_regionkey AS dataset, n_nationkey AS source, 'v' || (n_nationkey % CASE WHEN n_regionkey = 2 THEN 3 ELSE 4 END) AS stored FROM nation)
    SELECT dataset, max((marker IS DISTINCT FROM stored)::INT) AS due, string_agg(source || '=' || marker, ';' ORDER BY source) AS built_from FROM live LEFT JOIN stored USING (dataset, source) GROUP BY dataset""",
)
def due_datasets(spark: SparkSession, d: str) -> DataFrame:
    """SK9: datasets whose markers moved."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("dataset"), F.col("n_nationkey").alias("source"))
    mod = lambda m: F.concat(F.lit("v"), (F.col("source") % m).cast("string"))
    stored = n.withColumn("marker", F.when(F.col("dataset") == 2, mod(3)).otherwise(mod(4)))
    return U.due_sources(stored, n.withColumn("marker", mod(4)), "source", "dataset")


@query(
    "op_SK9_due_event_datasets",
    """WITH live AS (SELECT user_id AS dataset, event_type AS source, 'v' || max(event_id) AS marker FROM events GROUP BY ALL), stored AS (SELECT user_id AS dataset, event_type AS source, 'v' || max(event_id) AS stored FROM events WHERE event_id % 9 <> 0 GROUP BY ALL)
    SELECT dataset, max((marker IS DISTINCT FROM stored)::INT) AS due, string_agg(source || '=' || marker, ';' ORDER BY source) AS built_from FROM live LEFT JOIN stored USING (dataset, source) GROUP BY dataset""",
)
def due_event_datasets(spark: SparkSession, d: str) -> DataFrame:
    """SK9: one dataset a user, one source an event type; due if a marker moved."""
    e = table(spark, d, "events").select(F.col("user_id").alias("dataset"), F.col("event_type").alias("source"), "event_id")
    marked = lambda rows: rows.groupBy("dataset", "source").agg(F.concat(F.lit("v"), F.max("event_id").cast("string")).alias("marker"))
    return U.due_sources(marked(e.where("event_id % 9 <> 0")), marked(e), "source", "dataset")


_DIGEST = """CAST(count(*) AS BIGINT) AS n, CAST(sum(h) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor"""
_HASH = "('0x' || substr(md5('c_custkey=' || length(c_custkey::VARCHAR) || ':' || c_custkey || '|c_mktsegment=' || coalesce(length(c_mktsegment::VARCHAR) || ':' || c_mktsegment, '∅') || '|cents=' || length(cents::VARCHAR) || ':' || cents), 1, 12))::BIGINT AS h"


@query("op_SK10_table_digest", f"WITH {_VERSIONS}, x AS (SELECT c_nationkey, {_HASH} FROM new) SELECT c_nationkey, {_DIGEST} FROM x GROUP BY ALL")
def table_digest(spark: SparkSession, d: str) -> DataFrame:
    """SK10, M20: an order-free digest of each part."""
    return U.table_digest(_versions(spark, d)[1], ["c_nationkey"], ["c_custkey", "cents", "c_mktsegment"])


@query("op_SK10_changed_parts", f"WITH {_VERSIONS}, a AS (SELECT c_nationkey, sum(cents) AS s, sum(c_custkey) AS k, count(c_mktsegment) AS m, count(*) AS n FROM old WHERE c_nationkey <> 4 GROUP BY 1), b AS (SELECT c_nationkey, sum(cents) AS s, sum(c_custkey) AS k, count(c_mktsegment) AS m, count(*) AS n FROM new WHERE c_nationkey <> 9 GROUP BY 1) SELECT c_nationkey, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'gone' ELSE 'changed' END AS change FROM a FULL JOIN b USING (c_nationkey) WHERE a.n IS NULL OR b.n IS NULL OR a.n <> b.n OR a.m <> b.m OR a.s <> b.s OR a.k <> b.k")
def changed_parts(spark: SparkSession, d: str) -> DataFrame:
    """SK10: which parts changed since the last success."""
    old, new = _versions(spark, d)
    cols = ["c_custkey", "cents", "c_mktsegment"]
    return U.changed_parts(U.table_digest(old.where("c_nationkey <> 4"), ["c_nationkey"], cols), U.table_digest(new.where("c_nationkey <> 9"), ["c_nationkey"], cols), ["c_nationkey"])


@query("op_SK12_retention_plan", "SELECT 'orders' AS name, count(*) AS total, count(*) FILTER (WHERE year(o_orderdate) < 1997) AS old, CAST(min(year(o_orderdate)) AS INTEGER) AS oldest, CAST(max(year(o_orderdate)) AS INTEGER) AS newest, false AS refused FROM orders UNION ALL SELECT 'ancient', count(*), count(*), CAST(min(year(o_orderdate)) AS INTEGER), CAST(max(year(o_orderdate)) AS INTEGER), true FROM orders WHERE year(o_orderdate) = 1995")
def retention_plan(spark: SparkSession, d: str) -> DataFrame:
    """SK12: what a horizon would delete; emptying a table is refused."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"))
    return U.retention_plan(o, "orders", F.col("y"), F.lit(1997)).unionByName(U.retention_plan(o.where("y = 1995"), "ancient", F.col("y"), F.lit(1997)))


@query("op_SK13_fill_nulls", f"WITH {_VERSIONS} SELECT n.c_custkey, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment, n.c_mktsegment IS NULL AND o.c_mktsegment IS NOT NULL AS filled FROM new n LEFT JOIN old o USING (c_custkey)")
def fill_nulls(spark: SparkSession, d: str) -> DataFrame:
    """SK13: set only where nothing is stored."""
    old, new = _versions(spark, d)
    return U.fill_nulls(new.select("c_custkey", "c_mktsegment"), old, ["c_custkey"], "c_mktsegment")


@query("op_SK14_prefer_complete", "WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events) SELECT user_id, arg_min(event_id, (v IS NULL, event_id)) AS event_id FROM e GROUP BY user_id")
def prefer_complete(spark: SparkSession, d: str) -> DataFrame:
    """SK14: one row a key, with a value if any has one."""
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return U.prefer_complete(e, ["user_id"], "v", "event_id").select("user_id", "event_id")


@query("op_DQ1_constraints", "SELECT 'balance' AS rule, count(*) FILTER (WHERE NOT c_acctbal >= 0) AS violations FROM customer UNION ALL SELECT 'nation', count(*) FILTER (WHERE NOT c_nationkey BETWEEN 0 AND 23) FROM customer UNION ALL SELECT 'segment', count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) FROM customer")
def constraints(spark: SparkSession, d: str) -> DataFrame:
    """DQ1, SC7: violations of each rule in one pass."""
    c = Q.require_columns(table(spark, d, "customer"), ["c_acctbal", "c_nationkey", "c_mktsegment"])
    return Q.constraint_report(c, {"balance": F.col("c_acctbal") >= 0, "nation": F.col("c_nationkey").between(0, 23), "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY")})


@query("op_DQ2_freshness", "WITH l AS (SELECT event_type AS agent, max(ts) AS last FROM events WHERE event_type <> 'view' GROUP BY 1), t AS (SELECT DISTINCT event_type AS agent, CASE WHEN event_type = 'click' THEN 1 ELSE 480 END AS hours FROM events) SELECT agent, CASE WHEN last IS NULL THEN 'never_run' WHEN TIMESTAMP '2024-02-01' - last > hours * INTERVAL 1 HOUR THEN 'stale' ELSE 'fresh' END AS state FROM t LEFT JOIN l USING (agent)")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    """DQ2: last success against the tier's hours."""
    e = table(spark, d, "events").select(F.col("event_type").alias("agent"), "ts")
    tiers = e.select("agent", F.when(F.col("agent") == "click", 1).otherwise(480).alias("hours")).distinct()
    return Q.freshness(e.where("agent <> 'view'"), tiers, "agent", "ts", F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query("op_DQ3_floor_nulls", f"WITH {_VERSIONS} SELECT c_nationkey, count(*) AS n, round(avg((c_mktsegment IS NULL)::INT), 6) AS null_c_mktsegment, count(*) < 5 AS below_floor, avg((c_mktsegment IS NULL)::INT) > 0.1 AS too_null FROM new GROUP BY 1")
def floor_nulls(spark: SparkSession, d: str) -> DataFrame:
    """DQ3: row floor and null ceiling."""
    return Q.floor_and_nulls(_versions(spark, d)[1], ["c_nationkey"], 5, {"c_mktsegment": 0.1})


@query("op_DQ8_alert_diff", f"WITH {_VERSIONS} SELECT c_custkey, CASE WHEN o.cents IS NULL THEN 'new' WHEN n.cents IS NULL THEN 'cleared' WHEN o.cents <> n.cents THEN 'changed' ELSE 'unchanged' END AS state FROM old o FULL JOIN new n USING (c_custkey)")
def alert_diff(spark: SparkSession, d: str) -> DataFrame:
    """DQ8, DQ4: alerts new, changed, unchanged or cleared."""
    old, new = _versions(spark, d)
    return Q.alert_diff(old, new, "c_custkey", "cents")


@query("op_DQ9_snapshot_diff", f"WITH {_VERSIONS}, j AS (SELECT n.cents - o.cents AS d, o.c_mktsegment AS a, n.c_mktsegment AS b FROM old o JOIN new n USING (c_custkey)) SELECT 'cents' AS \"column\", count(*) AS changed, 0 AS to_null, 0 AS from_null, round(median(abs(d)::DOUBLE), 6) AS median_by, max(abs(d))::DOUBLE AS most FROM j WHERE d <> 0 UNION ALL SELECT 'c_mktsegment', count(*), count(*) FILTER (WHERE b IS NULL), count(*) FILTER (WHERE a IS NULL), NULL, NULL FROM j WHERE a IS DISTINCT FROM b")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """DQ9, DQ10, DQ11: how far columns moved between two snapshots."""
    old, new = _versions(spark, d)
    return Q.snapshot_diff(old, new, ["c_custkey"], ["cents", "c_nationkey", "c_mktsegment"])


@query("op_U5_vocabulary", f"WITH {_VERSIONS}, s AS (SELECT c_mktsegment AS code, count(*) AS n FROM new GROUP BY 1), l AS (SELECT code, count(*) AS sets FROM (VALUES ('BUILDING'), ('MACHINERY'), ('MACHINERY'), ('NOWHERE')) t(code) GROUP BY 1) SELECT coalesce(s.code, l.code) AS code, coalesce(n, 0) AS n, CASE WHEN coalesce(s.code, l.code) IS NULL THEN 'null' WHEN sets IS NULL THEN 'unlisted' WHEN n IS NULL THEN 'unused' WHEN sets > 1 THEN 'ambiguous' ELSE 'ok' END AS verdict FROM s FULL JOIN l ON s.code IS NOT DISTINCT FROM l.code")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Codes of the data against the sets, both ways."""
    sets = spark.createDataFrame([("BUILDING", "a"), ("MACHINERY", "a"), ("MACHINERY", "b"), ("NOWHERE", "b")], "code string, set string")
    return Q.vocabulary(_versions(spark, d)[1], "c_mktsegment", sets)


@query("op_U2_set_difference", f"WITH {_VERSIONS} SELECT c_custkey, 'gone' AS side FROM (SELECT c_custkey FROM old EXCEPT SELECT c_custkey FROM new) UNION ALL SELECT c_custkey, 'added' FROM (SELECT c_custkey FROM new EXCEPT SELECT c_custkey FROM old)")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    """Keys on one side only."""
    old, new = (v.select("c_custkey") for v in _versions(spark, d))
    return old.exceptAll(new).withColumn("side", F.lit("gone")).unionByName(new.exceptAll(old).withColumn("side", F.lit("added")))


@query("op_U3_overlap", f"WITH {LINES}, s AS (SELECT entity, epoch, list(DISTINCT part % 40) AS parts FROM lines GROUP BY ALL) SELECT a.entity, a.epoch, CAST(len(list_intersect(a.parts, b.parts)) AS INTEGER) AS shared FROM s a JOIN s b ON a.entity = b.entity AND b.epoch = a.epoch + 1")
def overlap(spark: SparkSession, d: str) -> DataFrame:
    """Members that two epochs share."""
    s = lines(spark, d).groupBy("entity", "epoch").agg(F.collect_set(F.col("part") % 40).alias("parts"))
    nxt = F.lead(F.struct("epoch", "parts")).over(Window.partitionBy("entity").orderBy("epoch"))
    s = s.withColumn("n", nxt).where(F.col("n.epoch") == F.col("epoch") + 1)
    return s.select("entity", "epoch", F.size(F.array_intersect("parts", "n.parts")).alias("shared"))


@query("op_V1_periods", "WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(o_orderdate AS DATE)::VARCHAR AS day, o_orderkey FROM orders), c AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity = 50) SELECT y, m, min(day) AS first_day, max(day) AS last_day, count(*) AS matches, count(l_orderkey) AS cards FROM o LEFT JOIN c ON o_orderkey = l_orderkey GROUP BY ALL")
def periods(spark: SparkSession, d: str) -> DataFrame:
    """V1: periods with their days and counts."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.to_date("o_orderdate").cast("string").alias("day"), "o_orderkey")
    c = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("card", F.lit(1))
    return o.join(c, "o_orderkey", "left").groupBy("y", "m").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("matches"), F.count("card").alias("cards"))


@query("op_V2_flattened_cards", "SELECT o_orderkey, o_orderstatus AS status, o_custkey AS customer, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders")
def flattened_cards(spark: SparkSession, d: str) -> DataFrame:
    """Nested JSON built and read back into typed columns."""
    o = table(spark, d, "orders")
    card = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").alias("id")).alias("customer"), F.struct(F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")).alias("price")))
    j = o.select("o_orderkey", F.from_json(card, "status string, customer struct<id: bigint>, price struct<cents: bigint>").alias("c"))
    return j.select("o_orderkey", "c.status", F.col("c.customer.id").alias("customer"), F.col("c.price.cents").alias("cents"))


@query("op_V5_rows_by_day", "SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1")
def rows_by_day(spark: SparkSession, d: str) -> DataFrame:
    """V5 over orders of priority 1: rows grouped by day in order."""
    return _by_day(table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")))


@query("op_V5_all_rows_by_day", "SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1")
def all_rows_by_day(spark: SparkSession, d: str) -> DataFrame:
    """V5: as op_V5_rows_by_day, over orders of every priority."""
    return _by_day(table(spark, d, "orders"))


def _by_day(o: DataFrame) -> DataFrame:
    return o.groupBy(F.to_date("o_orderdate").cast("string").alias("day")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("ids"))


@query("op_SC3_nested_json", "SELECT user_id AS match, event_type AS quoter, max(CASE WHEN event_id % 2 = 0 THEN CAST(round(value * 100) AS BIGINT) END) AS home_price, max(CASE WHEN event_id % 2 = 1 THEN CAST(round(value * 100) AS BIGINT) END) AS away_price, count(*) AS outcomes FROM events GROUP BY ALL")
def nested_json(spark: SparkSession, d: str) -> DataFrame:
    """SC3, SC4: quoters and outcomes exploded out of nested documents, sides by name."""
    e = table(spark, d, "events").select("user_id", "event_type", F.struct(F.when(F.col("event_id") % 2 == 0, "home").otherwise("away").alias("name"), F.round(F.col("value") * 100).cast("long").alias("price")).alias("o"))
    books = e.groupBy("user_id", "event_type").agg(F.collect_list("o").alias("outcomes")).groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("key"), "outcomes")).alias("bookmakers"))
    documents = books.select(F.to_json(F.struct(F.col("user_id").alias("id"), "bookmakers")).alias("doc"))
    return readers.quotes_from_json(documents, "doc")


@query("op_SC5_keyed_dump", "SELECT c_custkey::VARCHAR AS id, c_mktsegment AS status, c_nationkey AS team FROM customer WHERE c_acctbal > 0")
def keyed_dump(spark: SparkSession, d: str) -> DataFrame:
    """SC5: objects keyed by id, kept where they have a status."""
    c = table(spark, d, "customer")
    entry = F.struct(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("status"), F.col("c_nationkey").alias("team"))
    dumps = c.groupBy("c_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), entry)))).alias("doc"))
    return readers.keyed_entries(dumps, "doc", "status string, team int").where("status IS NOT NULL")


@query("op_SC6_columnar_hours", "SELECT o_custkey, CAST(i - 1 AS INTEGER) AS hour, list_extract(v, i) AS price FROM (SELECT o_custkey, list(CAST(round(o_totalprice * 100) AS BIGINT) ORDER BY o_orderkey) AS v, unnest(range(1, count(*) + 1)) AS i FROM orders GROUP BY 1)")
def columnar_hours(spark: SparkSession, d: str) -> DataFrame:
    """SC6: parallel arrays to rows."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("price")))).alias("v"))
    docs = o.select("o_custkey", F.to_json(F.struct(F.transform("v", lambda x: x.o_orderkey).alias("time"), F.transform("v", lambda x: x.price).alias("price"))).alias("doc"))
    return readers.columnar_rows(docs, "doc", "time array<bigint>, price array<bigint>").select("o_custkey", F.col("place").alias("hour"), "price")


@query("op_SC8_rss_items", "SELECT n_regionkey AS feed, n_name AS title, 'https://example.org/' || n_nationkey AS link FROM nation WHERE n_nationkey % 4 <> 0")
def rss_items(spark: SparkSession, d: str) -> DataFrame:
    """SC8: items of RSS documents with a title and a web link."""
    n = table(spark, d, "nation")
    link = F.concat(F.when(F.col("n_nationkey") % 4 == 0, F.lit("ftp://x/")).otherwise(F.lit("https://example.org/")), F.col("n_nationkey").cast("string"))
    item = F.concat(F.lit("<item><title>"), "n_name", F.lit("</title><link>"), link, F.lit("</link><pubDate>Tue, 02 Jan 2024 10:00:00 +0000</pubDate></item>"))
    feeds = n.groupBy(F.col("n_regionkey").alias("feed")).agg(F.concat(F.lit('<rss version="2.0"><channel>'), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("doc"))
    return readers.rss_items(feeds, "doc").select("feed", "title", "link")


@query("op_SC8_event_rss_items", "SELECT user_id AS feed, event_type AS title, 'https://example.org/' || event_id AS link FROM events WHERE event_id % 4 <> 0")
def event_rss_items(spark: SparkSession, d: str) -> DataFrame:
    """SC8: one RSS document a user, one item an event."""
    k = F.col("event_id")
    link = F.concat(F.when(k % 4 == 0, F.lit("ftp://x/")).otherwise(F.lit("https://example.org/")), k.cast("string"))
    item = F.concat(F.lit("<item><title>"), "event_type", F.lit("</title><link>"), link, F.lit("</link><pubDate>Tue, 02 Jan 2024 10:00:00 +0000</pubDate></item>"))
    feeds = table(spark, d, "events").groupBy(F.col("user_id").alias("feed")).agg(F.concat(F.lit('<rss version="2.0"><channel>'), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("doc"))
    return readers.rss_items(feeds, "doc").select("feed", "title", "link")


@query("op_SC10_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """SC10: a counter out of a JSON column."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("op_SC11_id_from_url", "SELECT page_id, coalesce(nullif(regexp_extract(url, '/(\\d+)(?:[/?#.-]|$)', 1), ''), nullif(regexp_extract(url, '([a-z]+)[^/]*$', 1), ''), 'unmatched:' || page_id) AS id FROM pages")
def id_from_url(spark: SparkSession, d: str) -> DataFrame:
    """SC11: an id by pattern, by a second one, else a synthetic one."""
    return table(spark, d, "pages").select("page_id", readers.id_from(F.col("url"), [r"/(\d+)(?:[/?#.-]|$)", r"([a-z]+)[^/]*$"], F.col("page_id")).alias("id"))


@query("op_SC1_pruned_scan", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1")
def pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    """SC1, SC9: the filter and the two columns reach the scan."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    x = table(spark, d, "lineitem").where((F.col("l_shipdate") >= at("1997-01-01")) & (F.col("l_shipdate") < at("1998-01-01")))
    return x.groupBy("l_returnflag").agg(F.count("*").alias("n"))
