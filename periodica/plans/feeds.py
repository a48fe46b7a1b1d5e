"""Queries: quotes, change-logs, calendars, geometry and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from periodica.functions import scalars as S
from periodica.operators import calendar as C
from periodica.operators import quotes as Q
from periodica.operators import state as ST
from periodica.operators.selection import quantiles
from periodica.plans.base import query, table
from periodica.sources.shared import shared_dir

_QUOTES = "q AS (SELECT user_id AS match, event_type AS quoter, CAST(dayofmonth(ts) AS INTEGER) AS day, arg_max(round(value / 5) / 2 - 5, (ts, event_id)) AS point FROM events GROUP BY ALL)"


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("match"), F.col("event_type").alias("quoter"), F.dayofmonth("ts").alias("day")).agg(F.max_by(F.round(F.col("value") / 5) / 2 - 5, F.struct("ts", "event_id")).alias("point"))


_CONSENSUS = f"WITH {_QUOTES}, c AS (SELECT match, day, median(point) AS middle, CASE WHEN count(*) >= 2 THEN max(point) - min(point) END AS spread, count(*) AS quoters, min(point) AS low, max(point) AS high FROM q GROUP BY ALL)"


@query("op_A8_consensus", _CONSENSUS + " SELECT * FROM c")
def consensus(spark: SparkSession, d: str) -> DataFrame:
    """Median line, range and quoters of each capture."""
    return Q.consensus(_quotes(spark, d), ["match", "day"], "point")


@query("op_A25_straddle_rate", _CONSENSUS + " SELECT day, count(*) AS n, count(*) FILTER (WHERE low <> high AND ((low <= 3 AND high >= 3) OR (low <= -3 AND high >= -3))) AS straddling, round(median(spread), 6) AS median_spread FROM c GROUP BY day")
def straddle_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of captures whose quoters straddle a key."""
    shared_dir(spark)
    c = consensus(spark, d)
    captures = c.groupBy("day", "spread").agg(F.count("*").alias("n"), F.count_if(Q.straddles([3, -3])).alias("straddling")).checkpoint()
    middle = quantiles(captures, ["day"], "spread", [0.5], F.col("n")).select("day", F.round("q0", 6).alias("median_spread"))
    return captures.groupBy("day").agg(F.sum("n").alias("n"), F.sum("straddling").alias("straddling")).join(middle, "day", "left")


@query(
    "op_W11_open_current_movement",
    _CONSENSUS + """, m AS (SELECT match, arg_min(middle, day) AS open, arg_max(middle, day) AS current, count(*) AS captures, min(day) AS a, max(day) AS b FROM c GROUP BY match)
    SELECT match, open, current, captures, CASE WHEN a <> b THEN current - open END AS move, CAST(len(list_filter([-7.0, -3.0, 3.0, 7.0], lambda k: least(open, current) < k AND k < greatest(open, current))) AS BIGINT) AS crossings FROM m""",
)
def movement(spark: SparkSession, d: str) -> DataFrame:
    """First and last consensus and the keys crossed between."""
    m = Q.movement(consensus(spark, d), "match", "day", "middle")
    return m.withColumn("crossings", S.key_crossings(F.col("open"), F.col("current"), [-7, -3, 3, 7]))


@query(
    "op_U4_equal_quoters",
    f"WITH {_QUOTES}, s AS (SELECT match, day, string_agg(quoter, ',' ORDER BY quoter) AS who FROM q GROUP BY ALL) SELECT match, day, who, coalesce(who = lag(who) OVER (PARTITION BY match ORDER BY day), false) AS same FROM s",
)
def equal_quoters(spark: SparkSession, d: str) -> DataFrame:
    """U4: whether two captures have the same quoters."""
    s = _quotes(spark, d).groupBy("match", "day").agg(F.array_join(F.array_sort(F.collect_set("quoter")), ",").alias("who"))
    return s.withColumn("same", F.coalesce(F.col("who") == F.lag("who").over(Window.partitionBy("match").orderBy("day")), F.lit(False)))


@query(
    "op_A13_devigged_chance",
    """WITH p AS (SELECT o_custkey AS match, o_orderpriority AS quoter, CASE WHEN o_orderkey % 2 = 0 THEN -(105 + o_orderkey % 90) ELSE 100 + o_orderkey % 150 END::DOUBLE AS home, CASE WHEN o_orderkey % 3 = 0 THEN -(101 + o_orderkey % 70) ELSE 100 + o_orderkey % 130 END::DOUBLE AS away FROM orders),
    c AS (SELECT match, CASE WHEN home < 0 THEN -home / (100 - home) ELSE 100 / (home + 100) END AS h, CASE WHEN away < 0 THEN -away / (100 - away) ELSE 100 / (away + 100) END AS a FROM p)
    SELECT match, round(median(h / (h + a)), 6) AS chance, count(*) AS quoters FROM c GROUP BY match""",
)
def devigged(spark: SparkSession, d: str) -> DataFrame:
    """Prices to chances, each quoter's margin taken out, then the median."""
    k = F.col("o_orderkey")
    home = F.when(k % 2 == 0, -(105 + k % 90)).otherwise(100 + k % 150).cast("double")
    away = F.when(k % 3 == 0, -(101 + k % 70)).otherwise(100 + k % 130).cast("double")
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("match"), S.price_chance(home).alias("h"), S.price_chance(away).alias("a"))
    return c.groupBy("match").agg(F.round(F.median(F.col("h") / (F.col("h") + F.col("a"))), 6).alias("chance"), F.count("*").alias("quoters"))


@query("op_X9_implied_totals", f"WITH {_QUOTES} SELECT match, quoter, day, (44 - point) / 2 AS home, (44 + point) / 2 AS away FROM q")
def implied_totals(spark: SparkSession, d: str) -> DataFrame:
    """Both sides' scores from line and total."""
    home, away = S.implied_totals(F.col("point"), F.lit(44))
    return _quotes(spark, d).select("match", "quoter", "day", home.alias("home"), away.alias("away"))


@query(
    "op_ST1_change_log",
    """WITH l AS (SELECT user_id, event_id, event_type, user_id % 2 AS src, lag(event_type) OVER w AS was, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, event_type FROM l WHERE i = 1 OR event_type <> was""",
)
def change_log(spark: SparkSession, d: str) -> DataFrame:
    """ST1 without a text rule: rows that differ from the one before."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return ST.change_log(e, ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@query("op_ST1_change_log_text")
def change_log_text(spark: SparkSession, d: str) -> DataFrame:
    """ST1: the order-dependent fold with a text rule; tested against a plain loop."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "props")
    return ST.change_log_with_text(e, "user_id", "event_id", "event_type", "props", r"[05]\}")


_POLLS = """polls AS (SELECT DISTINCT CAST(user_id % 2 AS INTEGER) AS src, user_id, CAST(dayofmonth(ts) AS INTEGER) AS day FROM events),
size AS (SELECT src, day, count(*) AS n FROM polls GROUP BY ALL), usual AS (SELECT *, avg(n) OVER (PARTITION BY src ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM size),
num AS (SELECT src, day, CAST(row_number() OVER (PARTITION BY src ORDER BY day) AS INTEGER) AS poll FROM usual WHERE u IS NULL OR n >= 0.5 * u)"""


def _polls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select((F.col("user_id") % 2).cast("int").alias("src"), "user_id", F.dayofmonth("ts").alias("day")).distinct()


@query(
    "op_ST2_absence_detection",
    f"""WITH {_POLLS}, s AS (SELECT p.src, user_id, poll, lead(poll) OVER (PARTITION BY p.src, user_id ORDER BY poll) AS nxt, max(poll) OVER (PARTITION BY p.src) AS last FROM polls p JOIN num USING (src, day)),
    g AS (SELECT src, user_id, poll, coalesce(nxt, (SELECT max(poll) FROM num z WHERE z.src = s.src) + 1) AS until FROM s)
    SELECT g.src, g.user_id, g.poll + 2 AS poll, num.day AS cleared_at FROM g JOIN num ON num.src = g.src AND num.poll = g.poll + 2 WHERE until - g.poll - 1 >= 2 AND g.user_id % 7 <> 0""",
)
def absence_detection(spark: SparkSession, d: str) -> DataFrame:
    """ST2, ST3: two missed polls in a row clear; outage polls don't count; sticky entities stay."""
    polls = _polls(spark, d)
    return ST.absences(polls, ST.poll_numbers(polls, "src", "day"), "src", "user_id", "day", F.col("user_id") % 7 == 0)


# The log by a walk through each source's polls, with all active entities in one list: what the distributed form must equal.
_GUARDED = """WITH RECURSIVE seen AS (SELECT CAST(user_id % 2 AS INTEGER) AS src, user_id AS id, CAST(epoch_us(ts) // 36000000000 AS INTEGER) AS poll, arg_max(event_type, event_id) AS st FROM events GROUP BY ALL),
p AS (SELECT src, poll, row_number() OVER (PARTITION BY src ORDER BY poll) AS i, list({'id': id, 'st': st}) AS rows, list(id) AS ids FROM seen GROUP BY src, poll),
r AS (
    SELECT src, 0::BIGINT AS i, 0 AS poll, 0::BIGINT AS size, 0::BIGINT AS expected, false AS out, []::STRUCT(id BIGINT, st VARCHAR, m BIGINT)[] AS active, []::BIGINT[] AS cleared FROM (SELECT DISTINCT src FROM p)
    UNION ALL
    SELECT src, i, poll, size, expected, out, list_filter(next, lambda a: a.m < 2 OR a.st = 'purchase'), list_transform(list_filter(next, lambda a: a.m >= 2 AND a.st <> 'purchase'), lambda a: a.id) FROM (
        SELECT *, list_transform(rows, lambda x: {'id': x.id, 'st': x.st, 'm': CASE WHEN out THEN coalesce(list_filter(active, lambda a: a.id = x.id)[1].m, 0) ELSE 0 END})
               || list_transform(list_filter(active, lambda a: NOT list_contains(ids, a.id)), lambda a: {'id': a.id, 'st': a.st, 'm': a.m + CASE WHEN out THEN 0 ELSE 1 END}) AS next
        FROM (SELECT *, size < 0.5 * expected AS out FROM (
            SELECT p.src, p.i, p.poll, len(p.rows) AS size, len(list_filter(r.active, lambda a: list_contains(p.ids, a.id) OR a.st <> 'purchase')) AS expected, r.active, p.rows, p.ids
            FROM r JOIN p ON p.src = r.src AND p.i = r.i + 1)))),
gone AS (SELECT src, unnest(cleared) AS id, poll FROM r),
told AS (SELECT src, id, poll, st, 1 AS kind FROM seen UNION ALL SELECT src, id, poll, NULL, 2 FROM gone),
was AS (SELECT *, lag(kind) OVER w AS before, lag(st) OVER w AS before_st FROM told WINDOW w AS (PARTITION BY src, id ORDER BY poll, kind))"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 2).cast("int").alias("src"), F.col("user_id").alias("key"), F.expr("unix_micros(cast(ts as timestamp)) div 36000000000").cast("int").alias("poll"), "event_type", "event_id")
    return e.groupBy("src", "key", "poll").agg(F.max_by("event_type", "event_id").alias("state"))


@query(
    "op_ST2_ST4_guarded_log",
    _GUARDED + """ SELECT src, id AS user_id, poll, CASE WHEN kind = 2 THEN 'cleared' WHEN before IS NULL THEN 'first' WHEN before = 2 THEN 'relisted' ELSE 'changed' END AS action, st AS state
    FROM was WHERE kind = 2 OR before IS NULL OR before = 2 OR st <> before_st""",
)
def guarded_log(spark: SparkSession, d: str) -> DataFrame:
    """ST1, ST2, ST3, ST4: the log with clears under the outage guard; a state can be sticky."""
    log, _ = ST.guarded_log(_states(spark, d), F.col("state") == "purchase")
    return log.withColumnRenamed("key", "user_id")


@query("op_ST3_poll_verdicts", _GUARDED + " SELECT src, poll, size, expected, out FROM r WHERE i > 0")
def poll_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """ST3: each poll's size beside what was expected of it (active, less absent sticky), and whether it is an outage."""
    _, verdicts = ST.guarded_log(_states(spark, d), F.col("state") == "purchase")
    return verdicts


@query(
    "op_ST5_presence",
    f"""WITH {_POLLS} SELECT p.src, p.user_id, max(poll) AS seen_poll, (SELECT max(poll) FROM num z WHERE z.src = p.src) - max(poll) AS misses FROM polls p JOIN num USING (src, day) GROUP BY p.src, p.user_id""",
)
def presence(spark: SparkSession, d: str) -> DataFrame:
    """ST5: last seen and misses since."""
    polls = _polls(spark, d)
    return ST.presence(polls, ST.poll_numbers(polls, "src", "day"), "src", "user_id", "day")


@query(
    "op_ST6_cross_source",
    """WITH l AS (SELECT user_id, event_type, max(event_id) AS as_of, arg_max(value, event_id) AS v FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL)
    SELECT user_id, max((v > 50)::INT) AS flagged, count(*) AS sources, coalesce(max(as_of) FILTER (WHERE event_type = 'click'), max(as_of)) AS as_of FROM l GROUP BY user_id""",
)
def cross_source(spark: SparkSession, d: str) -> DataFrame:
    """ST6: sources' latest rows to one verdict."""
    e = table(spark, d, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    latest = e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("as_of"), F.max_by("value", "event_id").alias("v"))
    return ST.resolved(latest, "user_id", "event_type", "click", F.col("v") > 50, "as_of")


_LEADS = [(72, 48), (48, 24), (24, 6), (6, 0)]


@query(
    "op_ST8_target_settlement",
    f"""WITH m AS (SELECT user_id, min(ts) + INTERVAL 5 DAY AS start FROM events GROUP BY 1), t AS (SELECT user_id, w.target, start - w.a * INTERVAL 1 HOUR AS opens, start - w.b * INTERVAL 1 HOUR AS closes FROM m, (VALUES {", ".join(f"('h{a}', {a}, {b})" for a, b in _LEADS)}) w(target, a, b)),
    f AS (SELECT t.user_id, target, opens, min(ts) AS hit FROM t LEFT JOIN events e ON e.user_id = t.user_id AND ts >= opens AND ts < closes GROUP BY t.user_id, target, opens)
    SELECT user_id, target, epoch_us(hit) AS hit_us, CASE WHEN hit IS NULL THEN 'missed_deadline' WHEN sum((hit IS NOT NULL)::INT) OVER (PARTITION BY user_id ORDER BY opens, target) > 2 THEN 'missed_cap' ELSE 'captured' END AS status FROM f""",
)
def target_settlement(spark: SparkSession, d: str) -> DataFrame:
    """ST7, ST8, J18, F17: capture windows before each match, settled by captures under a cap."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    matches = e.groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 5 DAYS")).alias("start"))
    s = C.settle(C.lead_windows(matches, "user_id", "start", _LEADS), e, "user_id", "ts", 2)
    return s.select("user_id", "target", F.unix_micros("captured_at").alias("hit_us"), "status")


@query(
    "op_ST10_lock",
    """WITH m AS (SELECT user_id, max(ts) AS start FROM events GROUP BY 1) SELECT m.user_id, arg_min(event_id, (ts, event_id)) AS locked_by FROM m JOIN events e ON e.user_id = m.user_id AND ts >= start - INTERVAL 48 HOUR AND ts < start GROUP BY m.user_id""",
)
def lock(spark: SparkSession, d: str) -> DataFrame:
    """ST10, F17: the first run inside the lock window."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.max("ts").over(Window.partitionBy("user_id")).alias("start"))
    inside = e.where((F.col("ts") >= F.col("start") - F.expr("INTERVAL 48 HOURS")) & (F.col("ts") < F.col("start")))
    return inside.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("locked_by"))


@query(
    "op_X2_local_days",
    """SELECT CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE)::VARCHAR AS day, count(*) AS n, count(*) FILTER (WHERE CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) <> CAST(ts AS DATE)) AS moved FROM events GROUP BY 1""",
)
def local_days(spark: SparkSession, d: str) -> DataFrame:
    """UTC instants on local calendar days, and how many change day."""
    ts = F.col("ts").cast("timestamp")
    e = table(spark, d, "events").select(C.local_day(ts, "America/New_York").alias("day"), F.to_date("ts").alias("utc"))
    return e.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("day") != F.col("utc")).alias("moved"))


@query(
    "op_X1_local_to_utc",
    """SELECT o_orderkey, epoch_us(timezone('America/New_York', CAST(o_orderdate AS DATE) + INTERVAL 20 HOUR + INTERVAL 15 MINUTE)) AS us, (epoch_us(timezone('Europe/Berlin', timezone('UTC', CAST(o_orderdate AS TIMESTAMP)))) - epoch_us(timezone('America/New_York', timezone('UTC', CAST(o_orderdate AS TIMESTAMP))))) / 3600000000 AS ahead FROM orders""",
)
def local_to_utc(spark: SparkSession, d: str) -> DataFrame:
    """Local day, clock and zone to an instant; difference of two zones."""
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.unix_micros(C.utc_of(day, F.lit("20:15"), "America/New_York")).alias("us"), C.zone_hours(F.col("o_orderdate").cast("timestamp"), "America/New_York", "Europe/Berlin").alias("ahead"))


@query(
    "op_X5_geometry",
    """WITH p AS (SELECT c_custkey, (c_custkey * 37 % 120 - 60)::DOUBLE AS la, (c_custkey * 91 % 340 - 170)::DOUBLE AS lo, (c_nationkey * 5 - 60)::DOUBLE AS lb, (c_nationkey * 13 - 160)::DOUBLE AS lp FROM customer)
    SELECT c_custkey, round(2 * 3958.8::DOUBLE * asin(least(sqrt(pow(sin(radians(lb - la) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin(radians(lp - lo) / 2), 2)), 1.0)), 4) AS miles,
      CASE WHEN c_custkey % 20 >= 8 THEN round(abs((c_custkey % 20) * cos(radians(lo - lp))), 6) END AS along, CASE WHEN c_custkey % 20 >= 8 THEN round(abs((c_custkey % 20) * sin(radians(lo - lp))), 6) END AS across_, CAST(((lo::BIGINT % 24 + 24 + 12) % 24) - 12 AS BIGINT) AS shift FROM p""",
)
def geometry(spark: SparkSession, d: str) -> DataFrame:
    """Great-circle miles, wind components, wrapped zone shift."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    p = table(spark, d, "customer").select("c_custkey", (k * 37 % 120 - 60).cast("double").alias("la"), (k * 91 % 340 - 170).cast("double").alias("lo"), (n * 5 - 60).cast("double").alias("lb"), (n * 13 - 160).cast("double").alias("lp"))
    along, across = S.wind_parts(k % 20, F.col("lo"), F.col("lp"))
    return p.select("c_custkey", F.round(S.haversine_miles(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp")), 4).alias("miles"), F.round(along, 6).alias("along"), F.round(across, 6).alias("across_"), S.zone_shift(F.col("lo").cast("long")).alias("shift"))


@query(
    "op_X8_full_window_only",
    """SELECT user_id, CAST(dayofmonth(ts) AS INTEGER) AS day, CASE WHEN count(DISTINCT event_type) = 5 THEN round(avg(value), 6) END AS mean, count(DISTINCT event_type) AS kinds FROM events GROUP BY ALL""",
)
def full_window_only(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate that is null unless all parts are there."""
    return table(spark, d, "events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.count_distinct("event_type").alias("kinds"), F.avg("value").alias("m")).select("user_id", "day", "kinds", F.when(F.col("kinds") == 5, F.round("m", 6)).alias("mean"))


@query(
    "op_X15_coin_tail",
    """WITH n AS (SELECT c_nationkey AS nation, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 4500) AS k FROM customer GROUP BY 1), t AS (SELECT nation, n, k, unnest(range(k, n + 1)) AS i FROM n)
    SELECT nation, n, k, round(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE))), 6) AS tail FROM t GROUP BY ALL""",
)
def coin_tail(spark: SparkSession, d: str) -> DataFrame:
    """Chance of at least k heads in n fair tosses."""
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 4500).alias("k"))
    return g.withColumn("tail", F.round(S.coin_tail(F.col("k"), F.col("n")), 6))


@query(
    "op_X19_span_parse",
    """WITH s AS (SELECT s_suppkey, s_suppkey % 5 + 2018 AS a, s_suppkey % 3 AS b FROM supplier) SELECT s_suppkey, unnest(list_concat(range(a, a + b + 1), [2031])) AS year FROM s""",
)
def span_parse(spark: SparkSession, d: str) -> DataFrame:
    """X19: "2018-2020, 2031" to years."""
    a, b = F.col("s_suppkey") % 5 + 2018, F.col("s_suppkey") % 3
    label = F.concat(a.cast("string"), F.lit("-"), (a + b).cast("string"), F.lit(", 2031"))
    return table(spark, d, "supplier").select("s_suppkey", F.explode(S.span_years(label).cast("array<bigint>")).alias("year"))


@query(
    "op_A9_recovered_denominator",
    """SELECT l_suppkey, CAST(round(median(l_extendedprice / (l_discount + 0.5))) AS BIGINT) AS base FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1""",
)
def recovered_denominator(spark: SparkSession, d: str) -> DataFrame:
    """A hidden denominator as the rounded median of count / share."""
    x = F.col("l_extendedprice") / (F.col("l_discount") + 0.5)
    return quantiles(table(spark, d, "lineitem").where("l_discount >= 0.05").select("l_suppkey", x.alias("x")), ["l_suppkey"], "x", [0.5]).select("l_suppkey", F.round("q0").cast("long").alias("base"))
