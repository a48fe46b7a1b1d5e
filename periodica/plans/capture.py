"""Queries: capture calendars, their settlement, locks by timers and states held by several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from periodica.operators import correction as K
from periodica.operators import locks as L
from periodica.operators import recompute as R
from periodica.operators import settlement as SE
from periodica.operators import state as ST
from periodica.operators.calendar import local_day, utc_of
from periodica.plans.base import query, table
from periodica.sources.shared import shared_path
from periodica.streaming import streams as T

ZONE = "America/New_York"
RULES = [
    SE.Fixed("week_opens", (-5, "10:00"), (-4, "09:00")), SE.Fixed("day_before", (-1, "10:00"), (0, "08:00")),
    SE.Slate("first_slate", 1, 6, cost=2), SE.Slate("late_slate", 1, 6, 15, cost=2), SE.Slate("thursday", 5, 6, cost=2), SE.Slate("monday", 2, 6, cost=2),
]

# The same rules in SQL: name, opens, closes, cost, of the firsts below.
_UTC = "epoch_us(timezone('America/New_York', CAST(anchor AS TIMESTAMP) + INTERVAL ({}) HOUR))"
_WINDOWS = " UNION ALL ".join(
    [f"SELECT *, '{t}' AS target, {_UTC.format(a)} AS opens, {_UTC.format(b)} AS closes, 1 AS cost FROM firsts WHERE anchor IS NOT NULL" for t, a, b in (("week_opens", "-110", "-87"), ("day_before", "-14", "8"))]
    + [f"SELECT *, '{t}', {c} - 21600000000, {c}, 2 FROM firsts WHERE anchor IS NOT NULL AND {c} IS NOT NULL" for t, c in (("first_slate", "sun"), ("late_slate", "late"), ("thursday", "thu"), ("monday", "mon"))]
)


def _firsts(keys: str) -> str:
    start = lambda day, more="": f"min(epoch_us(start)) FILTER (WHERE dayofweek(local) = {day}{more})"
    return f"firsts AS (SELECT {keys}, min(CAST(local AS DATE)) FILTER (WHERE dayofweek(local) = 0) AS anchor, {start(0)} AS sun, {start(0, ' AND hour(local) >= 15')} AS late, {start(4)} AS thu, {start(1)} AS mon FROM matches GROUP BY ALL), windows AS ({_WINDOWS})"


def _period(day):
    """Weeks from Tuesday to Monday."""
    return F.floor((F.datediff(day, F.lit("1970-01-01").cast("date")) + 2) / 7).cast("long")


_PERIOD = "CAST(floor((date_diff('day', DATE '1970-01-01', CAST({} AS DATE)) + 2) / 7.0) AS BIGINT)"


@query(
    "op_ST7_slate_windows",
    f"""WITH s AS (SELECT o_custkey % 40 AS league, CAST(o_orderdate AS DATE) + INTERVAL (9 + o_orderkey % 14) HOUR AS local FROM orders),
    matches AS (SELECT league, {_PERIOD.format("local")} AS period, timezone('America/New_York', local) AS start, local FROM s), {_firsts("league, period")}
    SELECT league, period, target, opens AS opens_us, closes AS closes_us, cost FROM windows""",
)
def slate_windows(spark: SparkSession, d: str) -> DataFrame:
    """ST7: windows of each week by local clocks and by slates, over seven years of clock changes; weeks without a Sunday match have none."""
    day = F.to_date("o_orderdate")
    clock = F.concat(F.lpad((F.col("o_orderkey") % 14 + 9).cast("string"), 2, "0"), F.lit(":00"))
    matches = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("league"), _period(day).alias("period"), utc_of(day, clock, ZONE).alias("start"))
    return SE.slate_windows(matches, ["league", "period"], "start", ZONE, 1, RULES).select("league", "period", "target", F.unix_micros("opens").alias("opens_us"), F.unix_micros("closes").alias("closes_us"), "cost")


_PERIOD_CAP, _MONTH_CAP = 3, 8


@query(
    "op_ST8_budgeted_settlement",
    f"""WITH RECURSIVE local_ts AS (SELECT *, timezone('America/New_York', timezone('UTC', ts + INTERVAL 2 DAY)) AS local, timezone('America/New_York', timezone('UTC', ts)) AS here FROM events),
    base AS (SELECT user_id AS key, {_PERIOD.format("local")} AS period, ts + INTERVAL 2 DAY AS start FROM local_ts WHERE event_type = 'purchase'),
    moved AS (SELECT user_id AS key, {_PERIOD.format("here")} AS period, min(epoch_us(ts)) AS known FROM local_ts WHERE event_type = 'error' AND user_id % 3 = 0 GROUP BY ALL),
    every AS (SELECT key, period, 1 AS version, NULL::BIGINT AS known, start FROM base UNION ALL SELECT key, period, 2, known, start + INTERVAL 90 MINUTE FROM base JOIN moved USING (key, period)),
    matches AS (SELECT * REPLACE (timezone('UTC', start) AS start), timezone('America/New_York', timezone('UTC', start)) AS local FROM every), {_firsts("key, period, version, known")},
    v AS (SELECT *, lead(known) OVER (PARTITION BY key, period, target ORDER BY version) AS until FROM windows),
    t AS (SELECT user_id AS key, epoch_us(ts) AS tick FROM events),
    met AS (SELECT v.key, period, target, version, opens, closes, cost, min(tick) FILTER (WHERE tick >= greatest(opens, coalesce(known, 0)) AND tick < closes) AS hit, min(tick) FILTER (WHERE tick >= greatest(closes, coalesce(known, 0))) AS dead
        FROM v LEFT JOIN t ON t.key = v.key AND tick < coalesce(until, 9223372036854775807) GROUP BY ALL),
    last AS (SELECT key, period, target, max(version) AS newest FROM v GROUP BY ALL),
    one AS (SELECT met.*, coalesce(hit, dead) AS e, row_number() OVER (PARTITION BY key, period, target ORDER BY coalesce(hit, dead) IS NULL, version) AS i, newest FROM met JOIN last USING (key, period, target)),
    judged AS (SELECT * FROM one WHERE (i = 1 AND e IS NOT NULL) OR (version = newest AND NOT EXISTS (SELECT 1 FROM one o WHERE o.key = one.key AND o.period = one.period AND o.target = one.target AND o.e IS NOT NULL))),
    hits AS (SELECT *, row_number() OVER (PARTITION BY key, e ORDER BY opens DESC, target DESC) AS place FROM judged WHERE hit IS NOT NULL),
    due AS (SELECT *, CAST(strftime(make_timestamp(e), '%Y%m') AS INTEGER) AS month, row_number() OVER (PARTITION BY key ORDER BY e) AS n FROM hits WHERE place = 1),
    f AS (SELECT key, 0::BIGINT AS n, -1::BIGINT AS period, '' AS target, 0 AS month, 0 AS by_period, 0 AS by_month, '' AS status FROM (SELECT DISTINCT key FROM due) UNION ALL
        SELECT key, n, period, target, month, p + CASE WHEN status = 'captured' THEN cost ELSE 0 END, m + CASE WHEN status = 'captured' THEN cost ELSE 0 END, status FROM (
            SELECT *, CASE WHEN p + cost > {_PERIOD_CAP} THEN 'period_cap' WHEN m + cost > {_MONTH_CAP} THEN 'month_cap' ELSE 'captured' END AS status FROM (
                SELECT due.key, due.n, due.period, due.target, due.month, due.cost, CASE WHEN f.period = due.period THEN by_period ELSE 0 END AS p, CASE WHEN f.month = due.month THEN by_month ELSE 0 END AS m FROM f JOIN due ON due.key = f.key AND due.n = f.n + 1)))
    SELECT j.key AS user_id, j.period, j.target, j.opens AS opens_us, j.closes AS closes_us, j.e AS decided_us, CASE WHEN j.e IS NULL THEN 'pending' WHEN j.hit IS NULL THEN 'deadline' ELSE coalesce(f.status, 'superseded') END AS status
    FROM judged j LEFT JOIN f ON f.key = j.key AND f.period = j.period AND f.target = j.target""",
)
def budgeted_settlement(spark: SparkSession, d: str) -> DataFrame:
    """ST7, ST8: every purchase announces a match two days on; some are moved by 90 minutes when an error comes in their week; any event is a tick."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    base = e.where("event_type = 'purchase'").withColumn("start", F.col("ts") + F.expr("INTERVAL 2 DAYS")).select("key", _period(local_day(F.col("start"), ZONE)).alias("period"), "start")
    moved = e.where("event_type = 'error' and key % 3 = 0").groupBy("key", _period(local_day(F.col("ts"), ZONE)).alias("period")).agg(F.unix_micros(F.min("ts")).alias("known"))
    first = base.select("key", "period", F.lit(1).alias("version"), F.lit(None).cast("long").alias("known"), "start")
    second = base.join(moved, ["key", "period"]).select("key", "period", F.lit(2).alias("version"), "known", (F.col("start") + F.expr("INTERVAL 90 MINUTES")).alias("start"))
    windows = SE.slate_windows(first.unionByName(second), ["key", "period", "version", "known"], "start", ZONE, 1, RULES)
    out = SE.settled(windows.withColumn("opens", F.unix_micros("opens")).withColumn("closes", F.unix_micros("closes")), e.select("key", F.unix_micros("ts").alias("at")), _PERIOD_CAP, _MONTH_CAP)
    return out.select(F.col("key").alias("user_id"), "period", "target", F.col("opens").alias("opens_us"), F.col("closes").alias("closes_us"), F.col("decided").alias("decided_us"), "status")


_LOCKS = """WITH r AS (SELECT user_id, epoch_us(date_trunc('week', ts) + INTERVAL 162 HOUR) AS start, epoch_us(ts) AS us, event_id FROM events WHERE event_type IN ('view', 'click')),
k AS (SELECT user_id, start, arg_min(event_id, (us, event_id)) FILTER (WHERE us >= start - 172800000000) AS id FROM r WHERE us < start GROUP BY ALL)
SELECT user_id, start AS start_us, CASE WHEN id IS NULL THEN 'missed' ELSE 'locked' END AS kind, id FROM k WHERE start < (SELECT max(epoch_us(ts)) FROM events WHERE event_type IN ('view', 'click')) - 600000000
UNION ALL SELECT user_id, start, 'rejected', event_id FROM r WHERE us >= start"""


def _runs(events: DataFrame) -> DataFrame:
    """Views and clicks as runs for their user's match of the week, which starts on Sunday at 18:00."""
    ts = F.col("ts").cast("timestamp")
    start = F.date_trunc("week", ts) + F.expr("INTERVAL 162 HOURS")
    return events.where(F.col("event_type").isin("view", "click")).select("user_id", F.unix_micros(start).alias("start"), F.unix_micros(ts).alias("at"), F.col("event_id").alias("id"), ts.alias("ts"))


@query("op_ST10_locks", _LOCKS)
def locks(spark: SparkSession, d: str) -> DataFrame:
    """ST10, DQ5, F17: the first run of the two days before a start locks it; starts without one are missed; later runs are rejected."""
    runs = _runs(table(spark, d, "events"))
    closed = (runs.agg(F.max("at")).first()[0] or 0) - 600_000_000  # one number
    return L.locks(runs.drop("ts"), ["user_id"], 48, closed).withColumnRenamed("start", "start_us")


@query("op_ST10_stream_locks", _LOCKS)
def stream_locks(spark: SparkSession, d: str) -> DataFrame:
    """ST10: the same locks out of a stream; a micro-batch gives out the starts that it has passed."""
    runs = _runs(T.stream_of(spark, f"{d}/events.parquet")).drop("ts")
    return T.locks(runs, ["user_id"], 48).withColumnRenamed("start", "start_us")


_AS_OF = "2024-01-20"


@query(
    "op_ST6_evidence",
    f"""WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS us, CASE WHEN value > 25 THEN 'out' WHEN value > 12 THEN 'limited' END AS state, event_id FROM events WHERE ts < TIMESTAMP '{_AS_OF}'),
    s AS (SELECT * FROM e WHERE event_type = 'click' OR (event_type = 'view' AND user_id % 2 = 0)),
    p AS (SELECT event_type, poll, row_number() OVER (PARTITION BY event_type ORDER BY poll DESC) - 1 AS misses FROM (SELECT DISTINCT event_type, us // 36000000000 AS poll FROM s)),
    l AS (SELECT user_id, event_type, last(state ORDER BY us, event_id) AS state, max(us) AS seen FROM s GROUP BY ALL),
    m AS (SELECT l.*, coalesce(state = 'out' AND misses >= 2, false) AS stale FROM l JOIN p ON p.event_type = l.event_type AND p.poll = seen // 36000000000),
    a AS (SELECT user_id, max(us) AS active FROM e WHERE event_type = 'purchase' GROUP BY 1),
    j AS (SELECT u.user_id, c.state AS cs, c.seen, coalesce(c.stale, false) AS stale, v.user_id IS NOT NULL AS other, v.state AS vs, active FROM (SELECT DISTINCT user_id FROM m) u LEFT JOIN m c ON c.user_id = u.user_id AND c.event_type = 'click' LEFT JOIN m v ON v.user_id = u.user_id AND v.event_type = 'view' LEFT JOIN a ON a.user_id = u.user_id),
    r AS (SELECT *, CASE WHEN stale AND other THEN 'yields' WHEN stale AND active > seen THEN 'acted' WHEN stale THEN 'stands' WHEN cs IS NOT NULL THEN 'fresh' WHEN vs IS NOT NULL THEN 'other' ELSE 'none' END AS rule FROM j)
    SELECT user_id, CASE WHEN rule IN ('stands', 'fresh') THEN cs ELSE vs END AS state, CASE WHEN rule IN ('stands', 'fresh') THEN 'click' WHEN vs IS NOT NULL THEN 'view' END AS source, CASE WHEN rule = 'stands' THEN seen END AS stale_since, rule FROM r""",
)
def evidence(spark: SparkSession, d: str) -> DataFrame:
    """ST6: states by clicks before states by views; a state `out` that its source has missed for two polls of ten hours is stale, and a purchase since is evidence against it."""
    e = table(spark, d, "events").where(F.col("ts") < F.lit(_AS_OF).cast("timestamp_ntz")).select("user_id", F.col("event_type").alias("source"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value", "event_id")
    said = e.where("source = 'click' or source = 'view' and user_id % 2 = 0").withColumn("state", F.when(F.col("value") > 25, "out").when(F.col("value") > 12, "limited"))
    poll = F.expr("us div 36000000000")
    polls = said.select("source", poll.alias("poll")).distinct().withColumn("misses", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("poll"))) - 1)  # a row a poll
    last = said.groupBy("user_id", "source").agg(F.max(F.struct("us", "event_id", "state")).alias("x")).select("user_id", "source", "x.us", "x.state", F.expr("x.us div 36000000000").alias("poll"))
    latest = last.join(polls, ["source", "poll"]).select("user_id", "source", "state", F.col("us").alias("seen"), F.coalesce((F.col("state") == "out") & (F.col("misses") >= 2), F.lit(False)).alias("stale"))
    return ST.with_evidence(latest, e.where("source = 'purchase'").select("user_id", F.col("us").alias("active")), "user_id", "click")


def _day_sums(where: str) -> str:
    return f"(SELECT user_id, CAST(dayofyear(ts) AS INTEGER) AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS num, count(*) AS den FROM events WHERE {where} GROUP BY ALL)"


_LATE = "event_type = 'error' AND user_id % 4 = 0 AND event_id % 3 = 0"


@query(
    "op_ST9_recomputed_periods",
    f"""WITH f AS (SELECT *, CAST(sum(num) OVER w AS BIGINT) AS to_num, CAST(sum(den) OVER w AS BIGINT) AS to_den FROM {_day_sums(f"NOT ({_LATE})")} WINDOW w AS (PARTITION BY user_id ORDER BY day)),
    g AS (SELECT *, CAST(sum(num) OVER w AS BIGINT) AS to_num, CAST(sum(den) OVER w AS BIGINT) AS to_den FROM {_day_sums("true")} WINDOW w AS (PARTITION BY user_id ORDER BY day))
    SELECT g.*, CASE WHEN f.user_id IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM g LEFT JOIN f USING (user_id, day) WHERE (g.num, g.den, g.to_num, g.to_den) IS DISTINCT FROM (f.num, f.den, f.to_num, f.to_den)""",
)
def recomputed_periods(spark: SparkSession, d: str) -> DataFrame:
    """ST9: some errors come late; the stored days from the first one of their user on are computed again, and what differs is given."""
    late = F.expr(_LATE)
    e = table(spark, d, "events").select("user_id", F.dayofyear("ts").alias("day"), F.round(F.col("value") * 100).cast("long").alias("num"), F.lit(1).cast("long").alias("den"), late.alias("late"))
    stored = R.stored_form(e.where("not late"), ["user_id"], "day", ["num", "den"])
    return R.changed_by(stored, e.where("late"), ["user_id"], "day", ["num", "den"])


@query(
    "op_DQ11_guarded_correction",
    """WITH e AS (SELECT user_id, CAST(round(value * 100) AS BIGINT) AS cents, CASE WHEN user_id % 10 = 3 AND event_type = 'error' THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS fixed FROM events)
    SELECT user_id, CAST(sum(cents) AS BIGINT) AS was, CAST(sum(fixed) AS BIGINT) AS now, count(*) AS n FROM e GROUP BY user_id""",
)
def guarded_correction(spark: SparkSession, d: str) -> DataFrame:
    """DQ11: errors of some users are set to nothing; the same for more users is refused, as totals out of scope would change. The result is read from the files after both."""
    path, schema = shared_path(spark, "corrected"), "user_id long, event_type string, cents long, day int"
    e = table(spark, d, "events").select("user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), F.dayofyear("ts").alias("day"))
    K.create(e, path, "day")
    totals = lambda rows: rows.groupBy("user_id").agg(F.sum("cents").alias("cents"))
    fix = lambda where: K.correct(spark, path, schema, "day", F.expr(where), {"cents": F.lit(0)}, totals, ["user_id"], F.col("user_id") % 10 == 3)
    fix("user_id % 10 = 3 and event_type = 'error'")
    try:
        fix("user_id % 5 = 3 and event_type = 'error'")
    except ValueError:
        pass
    was = totals(e).withColumnRenamed("cents", "was")
    return was.join(K.current(spark, path, schema).groupBy("user_id").agg(F.sum("cents").alias("now"), F.count("*").alias("n")), "user_id")
