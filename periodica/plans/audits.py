"""Queries: sources with their checks, scopes and statuses, ledgers, retention, views of a match, audits of captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from periodica.functions import scalars as S
from periodica.operators import checks as C
from periodica.operators import quality as Q
from periodica.operators import ledger, retention
from periodica.operators import upsert as U
from periodica.operators.windows import midrank
from periodica.plans.base import LINES, SQL, USER_DAYS, lines, query, table, user_days
from periodica.plans.more import _EDGES, _edges
from periodica.plans.ratings import _POISSON
from periodica.sources import readers
from periodica.sources.shared import shared_path

_SCOPE = "l_quantity IS NOT NULL AND (l_returnflag = 'A' OR l_returnflag = 'R') AND nullif(l_linestatus, 'P') <> 'O' AND nullif(l_linenumber, 2) <> 7 AND l_discount <> 0 AND l_tax <> 0.08 AND l_extendedprice > 1000 AND l_suppkey IS NOT NULL AND l_quantity <> 50"


@query("op_F3_scope_filter", f"SELECT l_suppkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE {_SCOPE} GROUP BY 1")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    """nine conditions; a comparison with null is neither true nor false, so it drops the row."""
    null_if = lambda c, x: F.nullif(F.col(c), F.lit(x))
    kept = (
        F.col("l_quantity").isNotNull() & ((F.col("l_returnflag") == "A") | (F.col("l_returnflag") == "R")) & (null_if("l_linestatus", "P") != "O") & (null_if("l_linenumber", 2) != 7)
        & (F.col("l_discount") != 0) & (F.col("l_tax") != 0.08) & (F.col("l_extendedprice") > 1000) & F.col("l_suppkey").isNotNull() & (F.col("l_quantity") != 50)
    )
    return table(spark, d, "lineitem").where(kept).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("s"))


@query("op_F12_status_classes", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS healthy, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS injury, count(*) FILTER (WHERE event_type = 'error') AS other, count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'purchase', 'error')) AS unknown_as_injury FROM events GROUP BY 1")
def status_classes(spark: SparkSession, d: str) -> DataFrame:
    """labels to healthy, injury or other; an unknown label counts as injury and is flagged."""
    kind, flagged = C.classified(F.col("event_type"), {"healthy": ("view",), "injury": ("click", "purchase"), "other": ("error",)}, "injury")
    e = table(spark, d, "events").select("user_id", kind.alias("kind"), flagged.alias("unknown"))
    n = lambda k: F.count_if((F.col("kind") == k) & ~F.col("unknown"))
    return e.groupBy("user_id").agg(n("healthy").alias("healthy"), n("injury").alias("injury"), n("other").alias("other"), F.count_if(F.col("unknown")).alias("unknown_as_injury"))


@query("op_F11_owner_guards", "SELECT * FROM (SELECT 'duplicate_key' AS guard, count(*) AS broken FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'two_owners', count(*) FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1) UNION ALL SELECT 'share_over_one', count(*) FROM lineitem WHERE l_discount * 12 > 1)")
def owner_guards(spark: SparkSession, d: str) -> DataFrame:
    """duplicate keys, members mapped to two owners, shares above one."""
    x = table(spark, d, "lineitem")
    return C.guard_report(x, ["l_orderkey", "l_linenumber"], "l_partkey", "l_suppkey", F.col("l_discount") * 12)


@query("op_F20_sourced_percentiles", f"WITH {USER_DAYS}, p AS (SELECT user_id, cohort, period, num, rank() OVER (PARTITION BY cohort, period ORDER BY num) - 1 AS below, count(*) OVER (PARTITION BY cohort, period, num) AS equal, count(*) OVER (PARTITION BY cohort, period) AS pop FROM user_days) SELECT user_id, period, CASE WHEN user_id % 3 <> 1 THEN CAST(floor((100 * (2 * below + equal) + pop) / (2 * pop)::DOUBLE) AS BIGINT) END AS pct FROM p")
def sourced_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """percentiles, null for rows of a source whose values aren't comparable."""
    p = midrank(user_days(spark, d), ["cohort", "period"], "num").withColumn("source", F.when(F.col("user_id") % 3 == 1, "outside").otherwise("own"))
    return p.select("user_id", "period", C.only_from(F.col("pct"), F.col("source"), ("outside",)).alias("pct"))


@query(
    "op_F22_row_status",
    f"""WITH {_EDGES}, s AS (SELECT epoch, entity, counterparty, edge, line, epoch < 1996 AS fitted, epoch = 1996 AS before_live, (entity + counterparty) % 5 = 0 AS no_card, margin % 3 = 0 AS locked, (entity + epoch) % 2 = 0 AS started, close_line > 3 AS unprojected FROM q)
    SELECT epoch, CAST(entity AS INTEGER) AS entity, CAST(counterparty AS INTEGER) AS counterparty, CASE WHEN no_card AND fitted THEN 'no card: in-sample' WHEN no_card AND before_live THEN 'no card: before go-live' WHEN no_card AND NOT started THEN 'no card yet' WHEN no_card THEN 'no card' WHEN unprojected THEN 'not projected' WHEN locked THEN 'locked' WHEN started THEN 'not locked' ELSE 'provisional' END AS status,
     NOT no_card AND edge * line > 0 AND edge <> line AS flipped FROM s""",
)
def row_status(spark: SparkSession, d: str) -> DataFrame:
    """why a row has no card, whether it is locked, and whether the favourite is another one than the market's."""
    s = _edges(spark, d)
    none, started = (F.col("entity") + F.col("counterparty")) % 5 == 0, (F.col("entity") + F.col("epoch")) % 2 == 0
    status = C.ladder(
        (none & (F.col("epoch") < 1996), "no card: in-sample"), (none & (F.col("epoch") == 1996), "no card: before go-live"), (none & ~started, "no card yet"), (none, "no card"),
        (F.col("close_line") > 3, "not projected"), (F.col("margin") % 3 == 0, "locked"), (started, "not locked"), otherwise="provisional",
    )
    flipped = ~none & (F.col("edge") * F.col("line") > 0) & (F.col("edge") != F.col("line"))
    return s.select("epoch", F.col("entity").cast("int").alias("entity"), F.col("counterparty").cast("int").alias("counterparty"), status.alias("status"), flipped.alias("flipped"))


@query("op_SC2_required_columns", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def required_columns(spark: SparkSession, d: str) -> DataFrame:
    """SC2: a source is refused before any job runs if it lacks columns (the refusal is tested); else it is read."""
    return Q.require_columns(table(spark, d, "orders"), ["o_orderkey", "o_orderstatus"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("op_SC4_chunked_blocks", "SELECT CAST(c_nationkey AS INTEGER) AS team, c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'note ' || c_mktsegment ELSE c_mktsegment END AS comment FROM customer")
def chunked_blocks(spark: SparkSession, d: str) -> DataFrame:
    """SC4: team blocks of at most 25 entries each, so no row grows with the data; a missing comment falls back to the first note."""
    k = F.col("c_custkey")
    entry = F.struct(k.alias("id"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("longComment"), F.struct(F.array(F.struct(F.concat(F.lit("note "), "c_mktsegment").alias("text"))).alias("items")).alias("notes"))
    docs = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("team"), F.floor(k / 25).alias("chunk")).agg(F.collect_list(entry).alias("entries"))
    e = docs.select(F.to_json(F.struct("team", "entries")).alias("doc")).select(F.from_json("doc", "team int, entries array<struct<id: bigint, longComment: string, notes: struct<items: array<struct<text: string>>>>>").alias("d")).select("d.team", F.explode("d.entries").alias("e"))
    return e.select("team", F.col("e.id").alias("id"), F.coalesce("e.longComment", F.get("e.notes.items", 0).getField("text")).alias("comment"))


@query("op_SC5_chunked_dump", "SELECT c_custkey::VARCHAR AS id, c_mktsegment AS status, CAST(c_nationkey AS INTEGER) AS team FROM customer WHERE c_acctbal > 0")
def chunked_dump(spark: SparkSession, d: str) -> DataFrame:
    """SC5: objects keyed by id, of at most 100 entries each, kept where they have a status and a team."""
    entry = F.struct(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("status"), F.col("c_nationkey").alias("team"))
    dumps = table(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("chunk")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), entry)))).alias("doc"))
    return readers.keyed_entries(dumps.select("doc"), "doc", "status string, team int").where("status IS NOT NULL AND team IS NOT NULL")


@query(
    "op_SC6_checked_hours",
    """WITH h AS (SELECT user_id, CAST(dayofmonth(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour, round(max(value), 4) AS v FROM events GROUP BY ALL), g AS (SELECT user_id, day, count(*) AS n, min(hour) AS a, max(hour) AS b FROM h GROUP BY ALL)
    SELECT user_id, day, CASE WHEN user_id % 10 = 3 THEN 'units' WHEN b - a + 1 <> n THEN 'hours' WHEN day % 9 = 0 THEN 'missing' ELSE 'ok' END AS verdict, n FROM g""",
)
def checked_hours(spark: SparkSession, d: str) -> DataFrame:
    """SC6: columnar hourly documents with their checks: units, an unbroken run of hours, no null in a required variable."""
    e = table(spark, d, "events").groupBy("user_id", F.dayofmonth("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.round(F.max("value"), 4).alias("v"))
    v = F.array_sort(F.collect_list(F.struct("hour", F.when(F.col("day") % 9 != 0, F.col("v")).alias("v"))))
    g = e.groupBy("user_id", "day").agg(v.alias("h"))
    unit = F.when(F.col("user_id") % 10 == 3, "kmh").otherwise("mph")
    doc = F.to_json(F.struct(F.struct(unit.alias("wind")).alias("units"), F.struct(F.col("h.hour").alias("time"), F.col("h.v").alias("wind")).alias("hourly")), {"ignoreNullFields": "false"})
    return readers.hourly_verdicts(g.select("user_id", "day", doc.alias("doc")), "doc", "wind", "mph")


@query("op_SC7_typed_csv", "SELECT s_suppkey AS id, CAST(s_nationkey AS INTEGER) AS nation, round(s_acctbal, 2) AS balance, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS names, s_suppkey % 7 <> 0 AS has_zone FROM supplier")
def typed_csv(spark: SparkSession, d: str) -> DataFrame:
    """SC7: a CSV written to the shared folder and read by a fixed schema, a list column split at bars, an empty field null."""
    path = shared_path(spark, "venues")
    s = table(spark, d, "supplier")
    names = F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit("|old "), "s_name")).otherwise(F.col("s_name"))
    s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.round("s_acctbal", 2).alias("balance"), names.alias("names"), F.when(F.col("s_suppkey") % 7 != 0, "America/New_York").alias("zone")).write.csv(path, header=True)
    v = readers.typed_csv(spark, path, "id long, nation int, balance double, names string, zone string", ("names",))
    return v.select("id", "nation", "balance", F.size("names").alias("names"), F.col("zone").isNotNull().alias("has_zone"))


@query(
    "op_SC7_venue_faults",
    """WITH v AS (SELECT CASE WHEN s_suppkey % 17 = 5 THEN s_suppkey - 1 ELSE s_suppkey END AS id, s_suppkey AS k FROM supplier), n AS (SELECT id FROM v GROUP BY id HAVING count(*) > 1)
    SELECT k AS row, id, array_to_string(list_filter([CASE WHEN k % 19 = 3 THEN 'names' END, CASE WHEN k % 23 = 7 THEN 'coordinates' END, CASE WHEN k % 29 = 2 THEN 'roof' END, CASE WHEN k % 31 = 6 THEN 'basis' END,
      CASE WHEN k % 4 < 2 AND k % 31 <> 6 AND k % 13 = 1 THEN 'bearing_range' END, CASE WHEN k % 31 <> 6 AND k % 37 = 9 AND k % 4 < 2 THEN 'bearing_iff_basis' END, CASE WHEN k % 11 = 4 THEN 'zone' END, CASE WHEN id IN (SELECT id FROM n) THEN 'duplicate_key' END], lambda x: x IS NOT NULL), ',') AS faults FROM v""",
)
def venue_faults(spark: SparkSession, d: str) -> DataFrame:
    """SC7: a CSV of venues read by a fixed schema and header, and what each of its rows breaks: names, ranges, codes, a bearing exactly where the basis keeps one, zones, repeated ids."""
    path, k = shared_path(spark, "venues"), F.col("s_suppkey")
    odd = k % 31 == 6
    basis = F.when(odd, "guessed").when(k % 4 == 0, "agrees").when(k % 4 == 1, "disagrees").when(k % 4 == 2, "no_field").otherwise("fixed_roof")
    has = (k % 4 < 2) & ~odd
    table(spark, d, "supplier").select(
        k.alias("row"), F.when(k % 17 == 5, k - 1).otherwise(k).alias("id"), F.when(k % 19 == 3, "|").otherwise(F.concat("s_name", F.lit("|old "), "s_name")).alias("names"),
        F.when(k % 23 == 7, 91.5).otherwise(k % 90 + 0.25).alias("lat"), (k % 180 - 0.5).alias("lon"), F.when(k % 29 == 2, "tent").when(k % 2 == 0, "open").otherwise("fixed").alias("roof"), basis.alias("bearing_basis"),
        F.when(has, F.when(k % 13 == 1, 180.0).otherwise((k % 180).cast("double"))).alias("bearing"), F.when(has & (k % 37 != 9), k).alias("outline"),
        F.when(k % 11 == 4, "Mars/Olympus").when(k % 2 == 0, "America/New_York").otherwise("Europe/London").alias("zone"),
    ).write.csv(path, header=True)
    v = readers.checked_header_csv(spark, path, "row long, id long, names string, lat double, lon double, roof string, bearing_basis string, bearing double, outline long, zone string", ("names",))
    rules = readers.venue_rules(("agrees", "disagrees", "no_field", "fixed_roof"), ("agrees", "disagrees"), ("fixed", "retractable", "open"))
    return Q.row_faults(v, "id", rules).select("row", "id", F.array_join("faults", ",").alias("faults"))


@query(
    "op_SC6_expected_hours",
    """WITH e AS (SELECT event_id, date_trunc('hour', ts::TIMESTAMP) AS h, CASE WHEN event_id % 13 = 1 THEN 'malformed' WHEN event_id % 11 = 2 THEN 'units' WHEN event_id % 17 = 3 THEN 'variables' WHEN event_id % 19 = 4 OR event_id % 23 = 5 THEN 'hours' WHEN event_id % 29 = 6 THEN 'no_data' ELSE 'ok' END AS verdict FROM events)
    SELECT event_id, verdict, CAST(k AS INTEGER) AS hour_offset, strftime(h + k * INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M') AS valid_time, (event_id % 40 + k)::DOUBLE AS wind, (event_id % 90 - k)::DOUBLE AS temperature, CASE WHEN event_id % 5 <> 0 THEN (event_id % 60)::DOUBLE END AS gusts
    FROM e, (SELECT unnest(range(0, 5)) AS k) WHERE verdict = 'ok' UNION ALL SELECT event_id, verdict, NULL, NULL, NULL, NULL, NULL FROM e WHERE verdict <> 'ok'""",
)
def expected_hours(spark: SparkSession, d: str) -> DataFrame:
    """SC6: five hours from each event's own, of three variables, out of columnar documents; the hours must be exactly those asked for, units must fit, wind and temperature must be known, gusts may be null."""
    k, hours = F.col("event_id"), readers.expected_hours(F.col("at"), 5)
    e = table(spark, d, "events").select(k, F.col("ts").cast("timestamp").alias("at")).withColumn("h", hours)
    ends_early = F.slice("h", 1, 4)
    time = F.when(k % 19 == 4, ends_early).when(k % 23 == 5, F.reverse("h")).otherwise(F.col("h"))
    e = e.withColumn("time", time)
    series = lambda f: F.transform(F.col("time"), lambda _, i: f(i).cast("double"))
    wind = F.when(k % 17 != 3, series(lambda i: F.when((k % 29 != 6) | (i != 2), k % 40 + i)))
    hourly = F.struct("time", wind.alias("wind"), series(lambda i: k % 90 - i).alias("temperature"), series(lambda i: F.when(k % 5 != 0, k % 60)).alias("gusts"))
    units = F.struct(F.lit("iso8601").alias("time"), F.when(k % 11 == 2, "km/h").otherwise("mp/h").alias("wind"), F.lit("F").alias("temperature"), F.lit("mp/h").alias("gusts"))
    doc = F.to_json(F.struct(units.alias("units"), hourly.alias("hourly")))
    doc = F.when(k % 13 == 1, F.substring(doc, 1, 60)).otherwise(doc)
    return readers.hourly_rows(e.select("event_id", "at", doc.alias("doc")), "doc", hours, {"wind": "mp/h", "temperature": "F", "gusts": "mp/h"}, ("wind", "temperature")).drop("at")


@query(
    "op_DQ1_iff_and_unique",
    "SELECT 'zone_iff_odd' AS rule, count(*) FILTER (WHERE (s_suppkey % 7 <> 0) <> (s_suppkey % 2 = 1)) AS violations FROM supplier UNION ALL SELECT 'unique_id', count(*) - count(DISTINCT s_suppkey) FROM supplier UNION ALL SELECT 'unique_nation', count(*) - count(DISTINCT s_nationkey) FROM supplier",
)
def iff_and_unique(spark: SparkSession, d: str) -> DataFrame:
    """DQ1: a field that must be null exactly where another condition says so, and columns that must be unique."""
    s = table(spark, d, "supplier").withColumn("zone", F.when(F.col("s_suppkey") % 7 != 0, "z"))
    rules = Q.constraint_report(s, {"zone_iff_odd": Q.iff_known(F.col("zone"), F.col("s_suppkey") % 2 == 1)})
    return rules.unionByName(Q.unique_report(s, {"unique_id": ["s_suppkey"], "unique_nation": ["s_nationkey"]}))


@query(
    "op_SC8_feed_report",
    """WITH f AS (SELECT user_id AS feed, count(*) AS items, count(*) FILTER (WHERE event_id % 4 <> 0) AS kept, count(*) FILTER (WHERE event_id % 4 <> 0 AND event_id % 5 <> 0) AS dated, CASE user_id % 10 WHEN 4 THEN 'version' WHEN 7 THEN 'malformed' WHEN 2 THEN 'empty' ELSE 'ok' END AS reason FROM events GROUP BY user_id)
    SELECT feed, reason, CASE WHEN reason = 'ok' THEN items END AS items, CASE WHEN reason = 'ok' THEN kept END AS kept, CASE WHEN reason = 'ok' THEN dated END AS dated FROM f""",
)
def feed_report(spark: SparkSession, d: str) -> DataFrame:
    """SC8: per feed how many items its document has, how many are kept and dated, and why a feed is refused; a refused one has no counts."""
    k = F.col("event_id")
    link = F.concat(F.when(k % 4 == 0, F.lit("ftp://x/")).otherwise(F.lit("https://example.org/")), k.cast("string"))
    item = F.concat(F.lit("<item><title>"), "event_type", F.lit("</title><link>"), link, F.lit("</link><pubDate>"), F.when(k % 5 == 0, "soon").otherwise("Tue, 02 Jan 2024 10:00:00 +0000"), F.lit("</pubDate></item>"))
    head = F.when(F.col("feed") % 10 == 4, '<rss version="0.9"><channel>').otherwise('<rss version="2.0"><channel>')
    tail = F.when(F.col("feed") % 10 == 7, "</rss").otherwise("</channel></rss>")
    body = F.when(F.col("feed") % 10 == 2, "").otherwise(F.array_join("items", ""))
    grouped = table(spark, d, "events").groupBy(F.col("user_id").alias("feed")).agg(F.collect_list(item).alias("items"))
    return readers.feed_verdicts(grouped.select("feed", F.concat(head, body, tail).alias("doc")), "doc")


@query("op_SK12_retention_apply", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY 1")
def retention_apply(spark: SparkSession, d: str) -> DataFrame:
    """SK12: a partitioned table rewritten without the years before the horizon; refused if it would empty the table, or if the count isn't as planned."""
    path = shared_path(spark, "retained")
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    o.write.partitionBy("y").parquet(path)
    kept = U.retained(spark.read.schema("o_orderkey long, y int").parquet(path), F.col("y"), 1997)
    return kept.groupBy("y").agg(F.count("*").alias("n"))


@query(
    "op_SK12_retention_files",
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS epoch, count(*) AS rows, year(o_orderdate) < 1997 AS goes, CASE WHEN year(o_orderdate) < 1997 THEN 0 ELSE count(*) END AS on_disk FROM orders GROUP BY year(o_orderdate)",
)
def retention_files(spark: SparkSession, d: str) -> DataFrame:
    """SK12: the plan of a deletion, carried out, beside the rows that the table's files hold afterwards, live or not."""
    path, schema = shared_path(spark, "orders-by-year"), "o_orderkey long, cents long, y int"
    o = table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.year("o_orderdate").alias("y"))
    retention.create(o, path, "y")
    plan = retention.apply(spark, path, schema, "y", 1997)
    held = spark.read.schema(schema).parquet(f"{path}/data").groupBy(F.col("y").alias("epoch")).agg(F.count("*").alias("on_disk"))
    return plan.join(held, "epoch", "left").select("epoch", "rows", "goes", F.coalesce("on_disk", F.lit(0)).alias("on_disk"))


@query(
    "op_SK11_observed_ledger",
    """WITH n AS (SELECT event_type AS job, count(*) AS rows FROM events GROUP BY 1), runs AS (
        SELECT job, 1 AS run, 'success' AS status, NULL AS reason, rows, rows AS written FROM n
        UNION ALL SELECT job, 2, 'skipped', 'unchanged', 0, rows FROM n
        UNION ALL SELECT job || '_none', 1, 'skipped', 'no input', 0, 0 FROM n
        UNION ALL SELECT job || '_refused', 1, 'failed', 'USER_RAISED_EXCEPTION', 0, 0 FROM n)
    SELECT job, run, status, reason, rows, written, true AS timed FROM runs""",
)
def observed_ledger(spark: SparkSession, d: str) -> DataFrame:
    """SK11: jobs that succeed, are skipped as unchanged or without input, or fail; a line's rows are beside what the job's table holds."""
    path, out = shared_path(spark, "runs"), shared_path(spark, "run-output")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    for job in [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]:  # a job each
        mine = e.where(F.col("event_type") == job)
        refused = F.raise_error(F.lit("refused")).cast("long")
        for name, rows in ((job, mine), (job, mine), (f"{job}_none", mine.where("false")), (f"{job}_refused", mine)):
            user = refused if name.endswith("_refused") else F.col("user_id")
            ledger.run_job(path, name, rows, lambda counted, n=name, u=user: counted.select("event_id", u.alias("user_id")).write.mode("overwrite").parquet(f"{out}/job={n}"))
    lines_ = ledger.entries(spark, path)
    run = F.row_number().over(Window.partitionBy("job").orderBy("at"))
    held = spark.read.schema("event_id long, user_id long, job string").parquet(out).groupBy("job").agg(F.count("*").alias("written"))
    return lines_.withColumn("run", run).join(held, "job", "left").select("job", "run", "status", "reason", "rows", F.coalesce("written", F.lit(0)).alias("written"), (F.col("seconds") > 0).alias("timed"))


@query("op_SK11_run_ledger", "SELECT event_type AS job, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'skipped: unchanged' ELSE 'success' END AS status, CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE count(*) END AS rows FROM events GROUP BY 1")
def run_ledger(spark: SparkSession, d: str) -> DataFrame:
    """SK11: one row a job run with its status and rows, appended to a ledger in the shared folder and read back."""
    path = shared_path(spark, "ledger")
    jobs = table(spark, d, "events").groupBy(F.col("event_type").alias("job")).agg(F.count("*").alias("n"))
    status = F.when(F.col("job") == "error", "failed").when(F.col("job") == "view", "skipped: unchanged").otherwise("success")
    entries = jobs.select("job", status.alias("status"), F.when(status == "success", F.col("n")).otherwise(0).alias("rows"), F.lit(0.0).alias("seconds"))
    U.append_ledger(entries, path)
    return spark.read.schema("job string, status string, rows long, seconds double, at timestamp").parquet(path).select("job", "status", "rows")


@query(
    "op_V4_match_signals",
    f"""WITH {LINES}, m AS (SELECT DISTINCT epoch, entity AS home, counterparty AS away FROM lines), own AS (SELECT epoch, entity AS home, counterparty AS away, 'match' AS sector, NULL::BIGINT AS team, CAST(sum(cents) AS BIGINT) AS value FROM lines GROUP BY ALL), t AS (SELECT epoch, entity AS team, CAST(sum(qty) AS BIGINT) AS value FROM lines GROUP BY ALL)
    SELECT epoch, CAST(home AS INTEGER) AS home, CAST(away AS INTEGER) AS away, sector, CAST(team AS INTEGER) AS team, value FROM (SELECT * FROM own UNION ALL SELECT m.epoch, home, away, 'period', t.team, t.value FROM m JOIN t ON t.epoch = m.epoch AND t.team = m.home UNION ALL SELECT m.epoch, home, away, 'period', t.team, t.value FROM m JOIN t ON t.epoch = m.epoch AND t.team = m.away WHERE m.away <> m.home)""",
)
def match_signals(spark: SparkSession, d: str) -> DataFrame:
    """V4: all rows behind a match: its own and the period rows of both its sides, as a union of equi joins."""
    x = lines(spark, d, "epoch", "entity", "counterparty", "cents", "qty")
    own = x.groupBy("epoch", F.col("entity").alias("home"), F.col("counterparty").alias("away")).agg(F.sum("cents").alias("value"))
    period = x.groupBy("epoch", F.col("entity").alias("team")).agg(F.sum("qty").alias("value"))
    sides = own.select("epoch", "home", "away", F.explode(F.array_distinct(F.array("home", "away"))).alias("team"))
    both = sides.join(period, ["epoch", "team"]).select("epoch", "home", "away", F.lit("period").alias("sector"), "team", "value")
    rows = own.select("epoch", "home", "away", F.lit("match").alias("sector"), F.lit(None).cast("int").alias("team"), "value").unionByName(both)
    return rows.withColumns({c: F.col(c).cast("int") for c in ("home", "away", "team")})


@query("op_V5_day_pages", "SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, CAST(o_custkey % 8 AS BIGINT) AS page, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY ALL")
def day_pages(spark: SparkSession, d: str) -> DataFrame:
    """V5: a page's rows grouped by day in order; a page is one of the keys, so no row gathers a whole day."""
    g = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").cast("string").alias("day"), (F.col("o_custkey") % 8).alias("page"))
    return g.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("ids"))


@query(
    "op_X15_coin_distance",
    """WITH n AS (SELECT c_nationkey AS nation, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 4500) AS k FROM customer GROUP BY 1), t AS (SELECT nation, n, k, unnest(range(k, n + 1)) AS i FROM n), p AS (SELECT nation, n, k, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.52::DOUBLE) + (n - i) * ln(0.48::DOUBLE))) AS tail FROM t GROUP BY ALL)
    SELECT CAST(nation % 5 AS INTEGER) AS part, round(avg((k::DOUBLE / n - 0.5) / sqrt(0.25 / n)), 6) AS mean_z, round(sum(tail), 5) AS expected, round(1 - product(1 - least(tail, 1.0::DOUBLE)), 5) AS at_least_one FROM p GROUP BY 1""",
)
def coin_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance from a fair coin in standard errors, binomial tails, how many are expected and the chance of at least one."""
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 4500).alias("k"))
    t = g.select((F.col("nation") % 5).cast("int").alias("part"), S.against_coin(F.col("k"), F.col("n")).alias("z"), F.least(S.binomial_tail(F.col("k"), F.col("n"), 0.52), F.lit(1.0)).alias("tail"))
    return t.groupBy("part").agg(F.round(F.avg("z"), 6).alias("mean_z"), F.round(F.sum("tail"), 5).alias("expected"), F.round(1 - F.product(1 - F.col("tail")), 5).alias("at_least_one"))


@query("op_X16_market_convention", f"WITH {_EDGES} SELECT epoch, CAST(entity AS INTEGER) AS entity, CAST(counterparty AS INTEGER) AS counterparty, CAST(-line AS BIGINT) AS closing, CAST(edge + line AS BIGINT) AS edge, CAST(margin - line AS BIGINT) AS cover, CAST(margin + edge AS BIGINT) AS residual FROM q")
def market_convention(spark: SparkSession, d: str) -> DataFrame:
    """Home-positive lines to market convention, then edges, margins against the close and residuals."""
    closing = S.market_line(F.col("line"))
    e = _edges(spark, d).select("epoch", "entity", "counterparty", closing.alias("closing"), (F.col("edge") - closing).alias("edge"), (F.col("margin") + closing).alias("cover"), (F.col("margin") - S.market_line(F.col("edge"))).alias("residual"))
    return e.withColumns({"entity": F.col("entity").cast("int"), "counterparty": F.col("counterparty").cast("int"), **{c: F.col(c).cast("long") for c in ("closing", "edge", "cover", "residual")}})


@query("op_X20_scaled_size", "SELECT c_nationkey AS nation, round(CASE WHEN count(*) > 0 THEN sum(length(c_name)) / count(*)::DOUBLE * count(*) FILTER (WHERE c_acctbal < 0) / 1e6 END, 9) AS megabytes FROM customer GROUP BY 1")
def scaled_size(spark: SparkSession, d: str) -> DataFrame:
    """What part of a table's bytes its old rows take."""
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.sum(F.length("c_name")).alias("size"), F.count("*").alias("total"), F.count_if(F.col("c_acctbal") < 0).alias("old"))
    return g.select("nation", F.round(S.scaled_size(F.col("size"), F.col("total"), F.col("old")), 9).alias("megabytes"))


@query(
    "op_J18_capture_targets",
    """WITH t AS (SELECT user_id, CAST(dayofmonth(ts) AS INTEGER) AS period, min(ts) AS captured_at FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT e.event_id, t.user_id IS NOT NULL AS on_target FROM events e LEFT JOIN t ON t.user_id = e.user_id AND t.period = dayofmonth(e.ts) AND t.captured_at = e.ts""",
)
def capture_targets(spark: SparkSession, d: str) -> DataFrame:
    """A capture belongs to its own period's target if it was taken at the target's captured time."""
    e = table(spark, d, "events").withColumn("period", F.dayofmonth("ts"))
    t = e.where("event_type = 'click'").groupBy("user_id", "period").agg(F.min("ts").alias("ts")).withColumn("on", F.lit(True))
    return e.join(t, ["user_id", "period", "ts"], "left").select("event_id", F.coalesce("on", F.lit(False)).alias("on_target"))


@query(
    "op_J19_reference_venues",
    """WITH v AS (SELECT n_nationkey AS k, (n_nationkey * 5 - 60)::DOUBLE AS lat, (n_nationkey * 13 - 160)::DOUBLE AS lon, n_nationkey % 24 AS zone FROM nation), m AS (SELECT DISTINCT s_nationkey AS home, c_nationkey AS away FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
    SELECT CAST(home AS INTEGER) AS home, CAST(away AS INTEGER) AS away, round(2 * 3958.8::DOUBLE * asin(least(sqrt(pow(sin(radians(h.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(h.lat)) * pow(sin(radians(h.lon - a.lon) / 2), 2)), 1.0)), 3) AS miles, CAST(((h.zone - a.zone + 36) % 24) - 12 AS BIGINT) AS shift FROM m JOIN v h ON h.k = home JOIN v a ON a.k = away""",
)
def reference_venues(spark: SparkSession, d: str) -> DataFrame:
    """A match's venue and the visitor's own, for distance and zone shift."""
    k = F.col("n_nationkey")
    v = table(spark, d, "nation").select(k.alias("k"), (k * 5 - 60).cast("double").alias("lat"), (k * 13 - 160).cast("double").alias("lon"), (k % 24).cast("long").alias("zone"))
    m = lines(spark, d, "entity", "counterparty").distinct().toDF("home", "away")
    j = m.join(v.toDF("home", "hla", "hlo", "hz"), "home").join(v.toDF("away", "ala", "alo", "az"), "away")
    return j.select(F.col("home").cast("int").alias("home"), F.col("away").cast("int").alias("away"), F.round(S.haversine_miles(F.col("ala"), F.col("alo"), F.col("hla"), F.col("hlo")), 3).alias("miles"), S.zone_shift(F.col("hz") - F.col("az")).alias("shift"))


_TARGETS = """t AS (SELECT user_id, CAST(dayofmonth(ts) AS INTEGER) AS day, max(ts) AS deadline, CASE max(event_id) % 5 WHEN 0 THEN 'captured' WHEN 1 THEN 'superseded' WHEN 2 THEN 'cap' WHEN 3 THEN 'deadline' END AS state FROM events GROUP BY ALL)"""


@query("op_DQ4_uncaptured_targets", f"WITH {_TARGETS} SELECT user_id, count(*) AS due, count(*) FILTER (WHERE state = 'captured') AS captured, count(*) FILTER (WHERE state IN ('superseded', 'cap')) AS explained, count(*) FILTER (WHERE coalesce(state, 'pending') NOT IN ('captured', 'superseded', 'cap')) AS unexplained FROM t WHERE deadline <= TIMESTAMP '2024-01-20' GROUP BY 1")
def uncaptured_targets(spark: SparkSession, d: str) -> DataFrame:
    """DQ4: targets whose window has closed, captured or not, and whether there is a reason; one still pending has none."""
    state = F.element_at(F.array(*map(F.lit, ("captured", "superseded", "cap", "deadline")), F.lit(None).cast("string")), (F.max("event_id") % 5 + 1).cast("int"))
    t = table(spark, d, "events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.max("ts").alias("deadline"), state.alias("state"))
    return Q.capture_report(t.where(F.col("deadline") <= F.lit("2024-01-20").cast("timestamp_ntz")), ["user_id"], "state", ("superseded", "cap"))


@query("op_DQ5_missed_locks", f"WITH {_TARGETS} SELECT user_id, count(*) FILTER (WHERE deadline > TIMESTAMP '2024-01-19' AND deadline <= TIMESTAMP '2024-01-20' AND state IS DISTINCT FROM 'captured') AS missed_locks, count(*) FILTER (WHERE deadline <= TIMESTAMP '2024-01-20' - INTERVAL 48 HOUR AND state = 'superseded') AS late_grades FROM t GROUP BY 1")
def missed_locks(spark: SparkSession, d: str) -> DataFrame:
    """DQ5: rows that started within the last day without a lock, and rows still ungraded two days after."""
    state = F.element_at(F.array(*map(F.lit, ("captured", "superseded", "cap", "deadline")), F.lit(None).cast("string")), (F.max("event_id") % 5 + 1).cast("int"))
    t = table(spark, d, "events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.max("ts").alias("deadline"), state.alias("state"))
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    recent = (F.col("deadline") > now - F.expr("INTERVAL 24 HOURS")) & (F.col("deadline") <= now)
    return t.groupBy("user_id").agg(F.count_if(recent & ~F.col("state").eqNullSafe(F.lit("captured"))).alias("missed_locks"), F.count_if((F.col("deadline") <= now - F.expr("INTERVAL 48 HOURS")) & (F.col("state") == "superseded")).alias("late_grades"))


@query(
    "op_DQ10_directed_differences",
    """WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS s FROM events GROUP BY 1), b AS (SELECT user_id, arg_max(CASE WHEN event_id % 6 = 0 THEN 'view' ELSE event_type END, event_id) AS s FROM events WHERE event_id % 41 <> 0 GROUP BY 1)
    SELECT CASE WHEN a.s IS NOT DISTINCT FROM b.s THEN 'same' WHEN b.s = 'view' AND a.s <> 'view' THEN 'expected' ELSE 'unexpected' END AS direction, count(*) AS n FROM a FULL JOIN b USING (user_id) GROUP BY 1""",
)
def directed_differences(spark: SparkSession, d: str) -> DataFrame:
    """DQ10: states by two histories; only flagged to healthy is a difference that replay may make."""
    e = table(spark, d, "events")
    last = lambda rows, s: rows.groupBy("user_id").agg(F.max_by(s, "event_id").alias("s"))
    before, after = last(e, F.col("event_type")), last(e.where("event_id % 41 <> 0"), F.when(F.col("event_id") % 6 == 0, "view").otherwise(F.col("event_type")))
    return Q.directed(before, after, "user_id", "s", "view").groupBy("direction").agg(F.count("*").alias("n"))


SQL["op_ST1_change_log_text"] = """WITH RECURSIVE o AS (SELECT user_id, event_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, i, event_id, true AS kept, event_type AS s, props AS t FROM o WHERE i = 1 UNION ALL
 SELECT o.user_id, o.i, o.event_id, c.kept, CASE WHEN c.kept THEN o.event_type ELSE f.s END, CASE WHEN c.kept THEN o.props ELSE f.t END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1, LATERAL (SELECT o.event_type IS DISTINCT FROM f.s OR (o.props IS DISTINCT FROM f.t AND regexp_matches(o.props, '[05]\\}')) AS kept) c)
SELECT user_id, event_id, s AS event_type, t AS props FROM f WHERE kept"""


_DRAWN = "('0x' || substr(md5(rep::VARCHAR || '|' || pair), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_REPS = "(SELECT unnest(range(0, 200)) AS rep)"


def _bound(hits: str, sign: str) -> str:
    p, zz = f"({hits}::DOUBLE / n)", "3.841458820694124::DOUBLE"
    return f"round(({p} + {zz} / (2 * n) {sign} 1.959963984540054::DOUBLE * sqrt({p} * (1 - {p}) / n + {zz} / (4 * n * n))) / (1 + {zz} / n), 6)"


SQL["op_M18_rule_intervals"] = f"""WITH {_EDGES}, h AS (SELECT epoch, entity || '-' || counterparty AS pair, ((edge > 0) = (margin > 0))::INT AS a, ((line < 0) = (margin > 0))::INT AS b FROM q WHERE edge <> 0),
g AS (SELECT epoch, count(*) AS n, CAST(sum(a) AS BIGINT) AS hits_a, CAST(sum(b) AS BIGINT) AS hits_b FROM h GROUP BY 1), c AS (SELECT epoch, pair, sum(a - b) AS num, count(*) AS den FROM h GROUP BY ALL), u AS (SELECT *, {_DRAWN} AS u FROM c, {_REPS}),
r AS (SELECT epoch, rep, sum(({_POISSON}) * num)::DOUBLE / nullif(sum(({_POISSON}) * den), 0) AS e FROM u GROUP BY ALL), ci AS (SELECT epoch, round(quantile_cont(e, 0.025), 6) AS low, round(quantile_cont(e, 0.975), 6) AS high FROM r GROUP BY 1)
SELECT g.*, low, high, {_bound("hits_a", "-")} AS low_a, {_bound("hits_a", "+")} AS high_a, {_bound("hits_b", "-")} AS low_b, {_bound("hits_b", "+")} AS high_b, round((hits_a - hits_b)::DOUBLE / n, 6) AS difference FROM g JOIN ci USING (epoch)"""

SQL["op_M16_edge_intervals"] = f"""WITH {_EDGES}, g AS (SELECT CASE WHEN abs(edge) < 3 THEN 'low' WHEN abs(edge) < 7 THEN 'mid' ELSE 'high' END AS bucket, epoch || '-' || entity || '-' || counterparty AS pair, edge::DOUBLE AS x, (margin + line)::DOUBLE AS y FROM q), u AS (SELECT *, {_DRAWN} AS u FROM g, {_REPS}), w AS (SELECT bucket, rep, x, y, ({_POISSON})::DOUBLE AS w FROM u),
s AS (SELECT bucket, rep, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * y * y) AS syy, sum(w * x * y) AS sxy FROM w GROUP BY ALL), e AS (SELECT bucket, (sw * sxy - sx * sy) / sqrt((sw * sxx - sx * sx) * (sw * syy - sy * sy)) AS e FROM s WHERE (sw * sxx - sx * sx) * (sw * syy - sy * sy) > 0),
ci AS (SELECT bucket, quantile_cont(e, 0.025) AS low, quantile_cont(e, 0.975) AS high FROM e GROUP BY 1), n AS (SELECT bucket, count(*) AS n, round(corr(x, y), 6) AS r FROM g GROUP BY 1)
SELECT n.bucket, n.n, n.r, round(low, 6) AS low, round(high, 6) AS high, low > 0 AS validated FROM n JOIN ci USING (bucket)"""
