"""Calendars, settlement, locks, evidence and recomputation: worked cases and plain loops."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from periodica.operators import correction, locks, recompute, settlement, state
from periodica.plans.capture import RULES, ZONE

UTC = dt.UTC


def windows_of(spark, *starts):
    rows = spark.createDataFrame([(1, dt.datetime(*s, tzinfo=UTC)) for s in starts], "week int, start timestamp")
    out = settlement.slate_windows(rows, ["week"], "start", ZONE, 1, RULES).select("target", F.date_format("opens", "MM-dd HH:mm").alias("a"), F.date_format("closes", "MM-dd HH:mm").alias("b"))
    return {r.target: (r.a, r.b) for r in out.collect()}


def test_windows_follow_clocks_and_slates(spark):
    # The clocks go back on Sunday 2024-11-03: ten o'clock is 14:00 UTC on Saturday, and eight is 13:00 on Sunday.
    got = windows_of(spark, (2024, 11, 3, 18, 0), (2024, 11, 3, 21, 5), (2024, 11, 3, 21, 25), (2024, 11, 1, 0, 15), (2024, 11, 5, 1, 15))
    assert got == {
        "week_opens": ("10-29 14:00", "10-30 13:00"), "day_before": ("11-02 14:00", "11-03 13:00"), "first_slate": ("11-03 12:00", "11-03 18:00"),
        "late_slate": ("11-03 15:05", "11-03 21:05"), "thursday": ("10-31 18:15", "11-01 00:15"), "monday": ("11-04 19:15", "11-05 01:15"),
    }


def test_slates_without_a_match_and_weeks_without_an_anchor_are_left_out(spark):
    assert set(windows_of(spark, (2024, 10, 6, 17, 0))) == {"week_opens", "day_before", "first_slate"}
    assert windows_of(spark, (2024, 10, 4, 0, 15)) == {}
    # An early match abroad is the anchor of the first slate.
    assert windows_of(spark, (2024, 10, 6, 13, 30), (2024, 10, 6, 17, 0))["first_slate"] == ("10-06 07:30", "10-06 13:30")


WINDOW = "key long, period long, target string, version int, known long, opens long, closes long, cost int"


def settled(spark, windows, ticks, period_cap=9, month_cap=9):
    out = settlement.settled(spark.createDataFrame(windows, WINDOW), spark.createDataFrame(ticks, "key long, at long"), period_cap, month_cap)
    return sorted(tuple(r) for r in out.select("key", "period", "target", "opens", "closes", "status", "decided").collect())


def by_loop(windows, ticks, period_cap, month_cap):
    """Each tick looks at all of its key's targets, with the versions known by then."""
    out, targets = [], {}
    for w in windows:
        targets.setdefault(w[:3], []).append(w[3:])
    spent, decided = Counter(), {}
    month = lambda at: dt.datetime.fromtimestamp(at / 1e6, UTC).strftime("%Y%m")
    for key, at in sorted(set(ticks)):
        now_open = []
        for target, versions in targets.items():
            if target[0] != key or target in decided:
                continue
            known = [v for v in sorted(versions) if v[1] is None or v[1] <= at]
            if known:
                _, _, opens, closes, cost = known[-1]
                if at >= closes:
                    decided[target] = (opens, closes, "deadline", at)
                elif at >= opens:
                    now_open.append((opens, target[2], target, closes, cost))
        for k, (opens, _, target, closes, cost) in enumerate(sorted(now_open, reverse=True)):
            status = "superseded"
            if k == 0:
                mine = [(key, target[1]), (key, month(at))]
                status = "period_cap" if spent[mine[0]] + cost > period_cap else "month_cap" if spent[mine[1]] + cost > month_cap else "captured"
                if status == "captured":
                    for m in mine:
                        spent[m] += cost
            decided[target] = (opens, closes, status, at)
    for target, versions in targets.items():
        _, _, opens, closes, _ = sorted(versions)[-1]
        out.append((*target, *decided.get(target, (opens, closes, "pending", None))))
    return sorted(out)


def test_settlement_equals_a_loop_over_ticks(spark):
    dice, day = random.Random(4), 86_400_000_000
    windows, ticks, seen = [], [], Counter()
    for key in range(40):
        for period in range(6):
            base = 19_720 * day + period * 7 * day
            for target in "abcd"[: dice.randint(1, 4)]:
                known, opens = None, base + dice.randint(0, 5 * day)
                for version in range(1, dice.choice([2, 2, 3, 4])):
                    windows.append((key, period, target, version, known, opens, opens + dice.choice([1, 6, 30]) * day // 24, dice.choice([1, 2])))
                    known = (known or base - day) + dice.randint(1, 3 * day)
                    opens += dice.choice([-1, 0, 1, 1]) * dice.randint(0, day)
        for _ in range(dice.choice([0, 10, 60])):
            ticks += [(key, 19_720 * day + dice.randint(-day, 43 * day))] * dice.choice([1, 1, 2])
    # A window may open or close just at a tick.
    ticks += [(w[0], w[k]) for w in windows[::7] for k in (5, 6)]
    want = by_loop(windows, ticks, 3, 8)
    assert settled(spark, windows, ticks, 3, 8) == want
    seen.update(w[5] for w in want)
    assert {"captured", "superseded", "period_cap", "month_cap", "deadline", "pending"} == set(seen)


def test_a_decided_target_keeps_its_window_and_a_pending_one_moves(spark):
    hour = 3_600_000_000
    moved = lambda known: [(1, 0, "a", 1, None, 10 * hour, 16 * hour, 1), (1, 0, "a", 2, known, 20 * hour, 26 * hour, 1)]
    assert settled(spark, moved(12 * hour), [(1, 11 * hour), (1, 21 * hour)]) == [(1, 0, "a", 10 * hour, 16 * hour, "captured", 11 * hour)]
    assert settled(spark, moved(9 * hour), [(1, 11 * hour), (1, 21 * hour)]) == [(1, 0, "a", 20 * hour, 26 * hour, "captured", 21 * hour)]
    assert settled(spark, moved(12 * hour), [(2, 11 * hour), (1, None), (None, 11 * hour)]) == [(1, 0, "a", 20 * hour, 26 * hour, "pending", None)]
    assert settled(spark, [], [(1, 5)]) == []


RUN = "user_id long, start long, at long, id long"


def test_locks_take_the_first_run_inside_and_refuse_later_ones(spark):
    h = locks.HOUR
    rows = [(1, 100 * h, 40 * h, 1), (1, 100 * h, 60 * h, 3), (1, 100 * h, 60 * h, 2), (1, 100 * h, 99 * h, 4), (1, 100 * h, 100 * h, 5), (2, 100 * h, 50 * h, 6), (3, 100 * h, 101 * h, 7), (4, 300 * h, 299 * h, 8), (5, None, h, 9), (5, 100 * h, None, 10)]
    got = sorted(((r.user_id, r.kind, r.id) for r in locks.locks(spark.createDataFrame(rows, RUN), ["user_id"], 48, 200 * h).collect()), key=str)
    assert got == [(1, "locked", 2), (1, "rejected", 5), (2, "missed", None), (3, "rejected", 7)]


def test_a_lock_out_of_the_stream_stays_whatever_comes_later(spark, tmp_path):
    """Files come one by one: what was given after two of them is there unchanged after late and later runs."""
    h, schema = locks.HOUR, "user_id long, start long, at long, id long, ts timestamp"
    batches = [
        [(1, 100 * h, 60 * h, 1), (2, 100 * h, 10 * h, 2), (3, 400 * h, 370 * h, 30)],
        [(1, 100 * h, 55 * h, 3), (1, 100 * h, 120 * h, 4), (3, 400 * h, 390 * h, 31)],  # 55 comes behind the watermark of 370
        [(2, 100 * h, 70 * h, 5), (1, 100 * h, 500 * h, 6), (3, 400 * h, 401 * h, 32)],
        [(1, 100 * h, 58 * h, 7), (4, 900 * h, 600 * h, 8)],
    ]
    given = []
    (tmp_path / "in").mkdir()
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "10 minutes")
    out = locks.lock_timers(rows, ["user_id"], 48)
    for n, batch in enumerate(batches):
        spark.createDataFrame([(*r, dt.datetime.fromtimestamp(r[2] / 1e6, UTC)) for r in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        given.append(sorted((r.user_id, r.kind, r.id or 0) for r in spark.read.schema("user_id long, start long, kind string, id long").parquet(str(tmp_path / "out")).collect()))
    for before, after in zip(given, given[1:]):
        assert not Counter(before) - Counter(after)
    assert [r for r in given[0] if r[1] != "rejected"] == [(1, "locked", 1), (2, "missed", 0)]
    assert [r for r in given[3] if r[1] != "rejected"] == [(1, "locked", 1), (2, "missed", 0), (3, "locked", 30)]
    assert {r[2] for r in given[3] if r[1] == "rejected"} <= {4, 6, 32} and (1, "rejected", 6) in given[3]


@pytest.mark.parametrize(
    ("sources", "active", "want"),
    [
        ([("a", "out", 5, True), ("b", None, 3, False)], None, (None, None, None, "yields")),
        ([("a", "out", 5, True), ("b", "limited", 3, False)], None, ("limited", "b", None, "yields")),
        ([("a", "out", 5, True)], None, ("out", "a", 5, "stands")),
        ([("a", "out", 5, True)], 6, (None, None, None, "acted")),
        ([("a", "out", 5, True)], 5, ("out", "a", 5, "stands")),
        ([("a", "out", 5, False), ("b", None, 9, False)], 9, ("out", "a", None, "fresh")),
        ([("a", None, 5, False), ("c", "out", 1, False), ("b", "limited", 1, False)], None, ("limited", "b", None, "other")),
        ([("b", None, 5, False)], 9, (None, None, None, "none")),
        ([("a", "out", None, True)], 9, ("out", "a", None, "stands")),
    ],
)
def test_held_states_yield_to_evidence(spark, sources, active, want):
    latest = spark.createDataFrame([(1, *s) for s in sources], "id long, source string, state string, seen long, stale boolean")
    rows = state.with_evidence(latest, spark.createDataFrame([(1, active), (2, 1)], "id long, active long"), "id", "a").collect()
    assert [tuple(r) for r in rows] == [(1, *want)]


def test_late_facts_write_what_differs_and_no_more(spark):
    dice = random.Random(9)
    fact = lambda: (dice.choice(["x", "y", "z", None]), dice.randint(1, 12), dice.choice([0, 1, 5]))
    schema = "k string, p int, v long"
    first, late = [fact() for _ in range(60)], [("x", 6, 4), ("x", 9, -4), ("q", 3, 1), (None, 11, 2), ("y", 4, 0), ("z", None, 7)]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    stored, full = (recompute.stored_form(frame(r), ["k"], "p", ["v"]) for r in (first, first + [x for x in late if x[1]]))
    changed = recompute.changed_by(stored, frame(late), ["k"], "p", ["v"])
    was, now = ({tuple(r) for r in df.collect()} for df in (stored, full))
    assert {tuple(r)[:-1] for r in changed.collect()} == now - was
    assert {(r.k, r.action) for r in changed.collect() if r.k == "q"} == {("q", "inserted")}
    assert all(r.p >= 6 for r in changed.where("k = 'x'").collect())
    assert {tuple(r) for r in recompute.merged(stored, changed, ["k"], "p").collect()} == now
    assert recompute.changed_by(stored, frame([]), ["k"], "p", ["v"]).count() == 0
    assert recompute.changed_by(frame([]).selectExpr("k", "p", "v", "v as to_v"), frame(late), ["k"], "p", ["v"]).count() == 5


def test_a_correction_goes_live_in_scope_and_changes_nothing_out_of_it(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "who string, v long, y int"
    rows = [("a", 1, 2020), ("a", 2, 2021), ("b", 3, 2020), ("b", 4, 2022), (None, 5, 2022)]
    correction.create(spark.createDataFrame(rows, schema), path, "y")
    held = lambda: sorted((tuple(r) for r in correction.current(spark, path, schema).collect()), key=str)
    total = lambda df: df.groupBy("who").agg(F.sum("v").alias("v"))
    fix = lambda where, v=0: correction.correct(spark, path, schema, "y", F.expr(where), {"v": F.lit(v)}, total, ["who"], F.col("who") == "a")
    files = lambda: sorted(str(p) for p in (tmp_path / "t").rglob("*.parquet"))
    start, on_disk = held(), files()
    for out_of_scope in ("v >= 2", "y = 2020", "who is null"):
        with pytest.raises(ValueError, match="outside"):
            fix(out_of_scope)
    assert held() == start and files() == on_disk
    assert fix("v > 100").count() == 0 and fix("v = 1", 1).count() == 0 and files() == on_disk
    assert [(r.who, r.was.v, r.now.v) for r in fix("v = 2", 9).collect()] == [("a", 3, 10)]
    assert held() == sorted([(r if r[1] != 2 else ("a", 9, 2021)) for r in rows], key=str)
    # Only the touched partition has been written, and the replaced one is there still.
    assert len(files()) == len(on_disk) + 1 and set(on_disk) < set(files())
    # A new version that holds other rows than it should: the one before is live again.
    read = correction.current
    with monkeypatch.context() as m:
        m.setattr(correction, "current", lambda s, p, k: read(s, p, k).where("v <> 77"))
        with pytest.raises(ValueError, match="rows are there"):
            fix("v = 1", 77)
    assert ("a", 1, 2020) in held()
    with pytest.raises(Exception, match="no epoch"):
        correction.create(spark.createDataFrame([("a", 1, None)], schema), path + "-none", "y")


def test_feeds_are_judged_by_their_documents(spark):
    from periodica.sources import readers

    item = "<item><title>t</title><link>https://x/1</link><pubDate>Tue, 02 Jan 2024 10:00:00 +0000</pubDate></item>"
    bare, undated = "<item><link>https://x/2</link></item>", "<item><title>t</title><link>http://x/3</link><pubDate>soon</pubDate></item>"
    feed = lambda items, version="2.0", end="</channel></rss>": f'<rss version="{version}"><channel>{items}{end}'
    docs = [feed(item + bare + undated), feed(item), feed(""), feed(item, "0.9"), feed(item, end="</rss"), feed(item, end=""), "not xml", None]
    rows = readers.feed_verdicts(spark.createDataFrame(list(enumerate(docs)), "id int, doc string"), "doc").orderBy("id").collect()
    assert [(r.reason, r["items"], r.kept, r.dated) for r in rows] == [("ok", 3, 2, 1), ("ok", 1, 1, 1), ("empty", None, None, None), ("version", None, None, None)] + [("malformed", None, None, None)] * 4
