"""Capture calendars anchored to local days and slates, and the settlement of their windows under budgets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodica.operators.calendar import utc_of


@dataclass(frozen=True)
class Fixed:
    """A window between two local clocks, on days counted from the period's anchor day."""

    target: str
    opens: tuple[int, str]
    closes: tuple[int, str]
    cost: int = 1


@dataclass(frozen=True)
class Slate:
    """A window of some hours before the first match of a weekday (1 is Sunday), from a local hour of it on."""

    target: str
    weekday: int
    hours: int
    from_hour: int = 0
    cost: int = 1


def slate_windows(matches: DataFrame, keys: list[str], start: str, zone: str, anchor: int, rules: list[Fixed | Slate]) -> DataFrame:
    """Windows (keys, target, opens, closes, cost) of each period that has a match on the anchor weekday; others have none.

    The anchor day is the first local day of that weekday with a match. Slates without a match are left out. Clocks are local, so a
    window over a clock change is an hour longer or shorter. One grouping with a minimum for each slate; a period's matches never meet in one task.
    """
    local = F.from_utc_timestamp(F.col(start), zone)
    firsts = {r.target: F.min(F.when((F.dayofweek(local) == r.weekday) & (F.hour(local) >= r.from_hour), F.col(start))) for r in rules if isinstance(r, Slate)}
    days = matches.groupBy(*keys).agg(F.min(F.when(F.dayofweek(local) == anchor, F.to_date(local))).alias("_anchor"), *[c.alias(f"_{t}") for t, c in firsts.items()])

    def window(r: Fixed | Slate):
        if isinstance(r, Slate):
            opens, closes = F.col(f"_{r.target}") - F.make_dt_interval(hours=F.lit(r.hours)), F.col(f"_{r.target}")
        else:
            opens, closes = [utc_of(F.date_add("_anchor", day), F.lit(clock), zone) for day, clock in (r.opens, r.closes)]
        return F.struct(F.lit(r.target).alias("target"), opens.alias("opens"), closes.alias("closes"), F.lit(r.cost).alias("cost"))

    rows = days.where("_anchor is not null").select(*keys, F.explode(F.array(*[window(r) for r in rules])).alias("w"))
    return rows.select(*keys, "w.*").where("opens is not null")


_SETTLED = pa.schema([("key", pa.int64()), ("period", pa.int64()), ("target", pa.string()), ("opens", pa.int64()), ("closes", pa.int64()), ("status", pa.string()), ("decided", pa.int64())])
_SETTLED_DDL = "key long, period long, target string, opens long, closes long, status string, decided long"


def _needed(ticks: DataFrame, rows: DataFrame) -> DataFrame:
    """The first tick of each key between two times at which a window opens, closes or is replaced.

    Between those times the set of open windows stands, and its first tick settles all of it. Ticks meet the few times of their own key and
    day, so a key with a large share of all ticks is spread over its days and counted down to a few before it is folded.
    """
    day = lambda c: F.expr(f"{c} div 86400000000")
    times = rows.select("key", F.explode(F.array("at", "opens", "closes", "until")).alias("t")).where("t is not null")
    times = times.groupBy("key", day("t").alias("day")).agg(F.collect_set("t").alias("times"))
    met = ticks.select("key", "at", "month", day("at").alias("day")).join(times, ["key", "day"], "left")
    part = F.coalesce(F.size(F.filter("times", lambda t: t <= F.col("at"))), F.lit(0))
    return met.groupBy("key", "day", part.alias("part")).agg(F.min(F.struct("at", "month")).alias("first")).select("key", "first.*")


def settled(windows: DataFrame, ticks: DataFrame, period_cap: int, month_cap: int) -> DataFrame:
    """What became of each target: captured, superseded, period_cap, month_cap, deadline, or pending if no tick has decided it.

    windows is (key long, period long, target string, version int, known long, opens long, closes long, cost int), times in microseconds; ticks is
    (key long, at long). Of a target's versions one is in force from its `known` (null: always) to the next one's; so a moved match moves its window,
    but only while the target is pending: a decided one keeps the window that it was judged by. A version moves only the targets it names.

    At a tick all pending windows that are open are decided: the one opened last (then the greater name) is due, the others are superseded.
    The due one is captured if its cost fits what the period and the tick's calendar month (UTC) have left of their caps, else it is refused by the first cap
    that it would break. A window whose end has passed is missed by its deadline. Repeated ticks change nothing; ticks without a window and windows that never
    open give no rows of their own but `pending`. Empty tables give no rows.

    A budget depends on the decisions before it, so a key is a fold in the order of its ticks: rows are sorted on disk and streamed through, with the key's open targets and
    its spending in hand, which grow with its periods and not with its ticks.
    """
    version = Window.partitionBy("key", "period", "target").orderBy("version")
    rows = windows.withColumn("until", F.lead("known").over(version)).withColumn("last", F.lead("version").over(version).isNull())
    rows = rows.withColumn("at", F.greatest(F.coalesce("known", "opens"), "opens")).where("until is null or at < until")
    thin = _needed(ticks.where("key is not null and at is not null").withColumn("month", F.date_format(F.timestamp_micros("at"), "yyyyMM").cast("int")), rows)
    names = ["key", "at", "tick", "month", "period", "target", "opens", "closes", "until", "cost", "last"]
    both = rows.withColumn("tick", F.lit(False)).withColumn("month", F.lit(None).cast("int")).select(*names).unionByName(thin.withColumn("tick", F.lit(True)), allowMissingColumns=True)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pending, done, spent = None, {}, set(), {}

        def row(target: tuple, window: tuple, status: str, at: int | None) -> tuple:
            return key, *target, *window[:2], status, at

        def decide(at: int, month: int) -> Iterator[tuple]:
            open_now = []
            for target, window in list(pending.items()):
                opens, closes, until, _, last = window
                if until is not None and at >= until:
                    del pending[target]  # its next version comes when that opens
                elif at >= closes or at >= opens:
                    del pending[target]
                    if not last:
                        done.add(target)
                    if at >= closes:
                        yield row(target, window, "deadline", at)
                    else:
                        open_now.append((opens, target[1], target, window))
            open_now.sort()
            for _, _, target, window in open_now[:-1]:
                yield row(target, window, "superseded", at)
            for _, _, target, window in open_now[-1:]:
                by_period, by_month, cost = ("period", target[0]), ("month", month), window[3]
                if spent.get(by_period, 0) + cost > period_cap:
                    yield row(target, window, "period_cap", at)
                elif spent.get(by_month, 0) + cost > month_cap:
                    yield row(target, window, "month_cap", at)
                else:
                    for budget in (by_period, by_month):
                        spent[budget] = spent.get(budget, 0) + cost
                    yield row(target, window, "captured", at)

        def rest() -> Iterator[tuple]:
            return (row(target, window, "pending", None) for target, window in pending.items() if window[4])

        for batch in batches:
            out = []
            for k, at, tick, month, period, target, opens, closes, until, cost, last in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != key:
                    out += rest()
                    key, pending, done, spent = k, {}, set(), {}
                if tick:
                    out += decide(at, month)
                elif (period, target) not in done:
                    pending[period, target] = opens, closes, until, cost, last
            yield pa.RecordBatch.from_pylist([dict(zip(_SETTLED.names, x, strict=True)) for x in out], schema=_SETTLED)
        yield pa.RecordBatch.from_pylist([dict(zip(_SETTLED.names, x, strict=True)) for x in rest()], schema=_SETTLED)

    # A window that comes into force at a tick's time is there before the tick.
    return both.select(*names).repartition("key").sortWithinPartitions("key", "at", "tick", "period", "target").mapInArrow(fold, _SETTLED_DDL)
