"""Worked values, fixed points, no-leak and scenario tests on small frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodica.functions import scalars as S
from periodica.operators import quality, rating, state, stats, upsert, windows
from periodica.operators.rollup import run_labels


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_midrank_of_three(spark):
    rows = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3), (4, None)], "id int, v double").withColumn("g", F.lit(1))
    got = {r.id: r.pct for r in windows.midrank(rows, ["g"], "v").collect()}
    assert got == {1: 17, 2: 50, 3: 83, 4: None}


def test_as_of_percentile_keeps_absent_and_drops_ineligible(spark):
    rows = spark.createDataFrame([("A", 1, 0.1, 5), ("A", 2, 0.2, 5), ("B", 1, 0.15, 5), ("B", 2, 0.3, 5), ("C", 1, 0.1, 5), ("D", 1, 0.9, 5), ("D", 2, 0.9, 1)], "e string, p int, v double, n int").withColumn("c", F.lit(1))
    got = {(r.e, r.p): r.pct for r in windows.as_of_percentile(rows, "e", "c", "p", "v", F.col("n") >= 3, 2).collect()}
    assert (got["A", 2], got["B", 2]) == (50, 83) and ("D", 2) not in got


def test_windows_never_look_ahead(spark):
    past = [(1, p, 10 * p, p) for p in range(1, 6)]
    schema = "e int, p int, num long, den long"
    before = {r.p: r for r in windows.three_windows(spark.createDataFrame(past, schema), ["e"], "p", "num", "den").collect()}
    after = {r.p: r for r in windows.three_windows(spark.createDataFrame([*past, (1, 6, 9999, 1)], schema), ["e"], "p", "num", "den").collect()}
    assert all(before[p] == after[p] for p in before)


def test_worked_scalars(spark):
    r = one(spark, a=S.implied_totals(F.lit(-3.0), F.lit(44.0))[0], b=S.implied_totals(F.lit(-3.0), F.lit(44.0))[1], clv=S.closing_value(F.lit(2.0), F.lit(-3.0), F.lit(-4.0)), low=S.wilson(F.lit(7), F.lit(12))[0], high=S.wilson(F.lit(7), F.lit(12))[1], shift=S.zone_shift(F.lit(17)), none=S.ratio(F.lit(1.0), F.lit(0.0)), nan=S.cleaned(F.lit(float("nan"))), keys=S.key_crossings(F.lit(-2.5), F.lit(3.0), [-3, 3]))
    assert (r.a, r.b, r.clv, r.shift, r.none, r.nan, r["keys"]) == (23.5, 20.5, 1.0, -7, None, None, 0)
    assert r.low == pytest.approx(0.32, abs=0.005) and r.high == pytest.approx(0.81, abs=0.005)


def test_late_exclusion_keeps_nulls(spark):
    r = one(spark, a=S.late_exclusion(F.lit(2), F.lit(0.999)), b=S.late_exclusion(F.lit(3), F.lit(0.97)), c=S.late_exclusion(F.lit(4), F.lit(0.97)), d=S.late_exclusion(F.lit(4), F.lit(None).cast("double")))
    assert (r.a, r.b, r.c, r.d) == (False, False, True, False)


def test_run_labels(spark):
    rows = spark.createDataFrame([(1, y) for y in (2023, 2025, 2026, 2026)], "k int, y int")
    assert run_labels(rows, ["k"], "y").first().span == "2023, 2025-2026"


def test_blend_weights(spark):
    value, stability = S.blend(F.lit(2.0), F.lit(10.0), 10.0, F.lit(1.0), F.lit(0.5), F.lit(0.0))
    r = one(spark, v=value, s=stability)
    assert r.v == pytest.approx(0.5 * 2 + 0.25 * 1) and r.s == pytest.approx(0.75)
    value, stability = S.blend(F.lit(None).cast("double"), F.lit(0.0), 10.0, F.lit(None).cast("double"), F.lit(0.5), F.lit(3.0))
    r = one(spark, v=value, s=stability)
    assert r.v is None and r.s == 0


def plain_ratings(pairs, k, rounds):
    league = sum(n for *_, n, _ in pairs) / sum(d for *_, d in pairs)
    off, de = ({p[i]: league for p in pairs} for i in (0, 1))
    for _ in range(rounds):
        new = []
        for side, other, i, j in ((off, de, 0, 1), (de, off, 1, 0)):
            d = {x: sum(p[3] for p in pairs if p[i] == x) for x in side}
            raw = {x: (sum(p[2] + p[3] * (league - other[p[j]]) for p in pairs if p[i] == x) + k * league) / (d[x] + k) for x in side}
            mean = sum(raw[x] * d[x] for x in raw) / sum(d.values())
            new.append({x: v + league - mean for x, v in raw.items()})
        off, de = new
    return off, de


def test_solver_meets_plain_iteration_and_its_fixed_point(spark):
    dice = random.Random(3)
    pairs = [(a, b, float(dice.randint(1, 90)), float(dice.randint(5, 20))) for a in range(6) for b in range(6) if a != b]
    rows = spark.createDataFrame([(1, *p) for p in pairs], "g int, entity int, counterparty int, num double, den double")
    off, de = plain_ratings(pairs, 10.0, 3)
    for r in rating.adjusted(rows, ["g"], 10.0, 3).collect():
        assert r.value == pytest.approx((off if r.side == "off" else de)[r.id], abs=1e-9)
    solved = rating.solved(rows, ["g"], 10.0, 1e-4, 60).checkpoint()
    again = {(r.id, r.side): r.value for r in rating.iterate(rating.arms(rows, ["g"]), solved, ["g"], 10.0).collect()}
    assert all(again[r.id, r.side] == pytest.approx(r.value, abs=2e-4) for r in solved.collect())


def test_change_log_with_text_compares_with_last_emitted(spark):
    rows = [("a", 1, "out", "x"), ("a", 2, "out", "note"), ("a", 3, "out", "surgery"), ("a", 4, "out", "note"), ("a", 5, "in", "note"), ("b", 1, "in", None)]
    got = state.change_log_with_text(spark.createDataFrame(rows, "k string, t int, s string, n string"), "k", "t", "s", "n", "surgery").collect()
    assert sorted((r.k, r.t) for r in got) == [("a", 1), ("a", 3), ("a", 5), ("b", 1)]


def test_absence_needs_two_misses_in_a_row_and_ignores_outages(spark):
    everyone = [(f"e{i}", day) for day in range(1, 8) for i in range(6)]
    gone = {("e0", 3), ("e0", 4), ("e1", 3), ("e1", 5)} | {(f"e{i}", 6) for i in range(5)}
    polls = spark.createDataFrame([(0, e, d) for e, d in everyone if (e, d) not in gone], "src int, k string, day int")
    numbers = state.poll_numbers(polls, "src", "day")
    assert sorted(r.day for r in numbers.collect()) == [1, 2, 3, 4, 5, 7]
    got = [(r.k, r.cleared_at) for r in state.absences(polls, numbers, "src", "k", "day", F.lit(False)).collect()]
    assert got == [("e0", 4)]


def test_merge_keeps_first_and_touches_only_changes(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, None, 20), (3, "c", 30)], "k int, name string, v int")
    new = spark.createDataFrame([(1, "z", 11), (2, "b", 20), (4, "d", 40)], "k int, name string, v int")
    got = {r.k: (r.name, r.v) for r in upsert.merged(old, new, ["k"], ("name",)).collect()}
    assert got == {1: ("a", 11), 2: ("b", 20), 3: ("c", 30), 4: ("d", 40)}
    acts = {r.k: r.action for r in upsert.classify(old, new, ["k"]).collect()}
    assert acts == {1: "update", 2: "update", 3: "keep", 4: "insert"}


def test_missing_columns_are_named(spark):
    with pytest.raises(quality.MissingColumns, match="b, c"):
        quality.require_columns(spark.range(1).withColumnRenamed("id", "a"), ["a", "b", "c"])


def test_ols_recovers_coefficients(spark):
    dice = np.random.default_rng(1)
    x = dice.normal(size=(400, 2))
    y = 3 + x @ [2.0, -1.0] + dice.normal(size=400) * 0.1
    rows = spark.createDataFrame([(int(i // 2), float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))], "m int, a double, b double, y double")
    got = {r.term: r for r in stats.ols_clustered(rows, "y", ["a", "b"], "m").collect()}
    assert [got[t].estimate for t in ("intercept", "a", "b")] == pytest.approx([3, 2, -1], abs=0.03)
    assert 0.003 < got["a"].se < 0.01


def test_binomial_tails_of_many_trials(spark):
    for n, k, p in ((1, 1, 0.3), (7, 0, 0.3), (7, 7, 0.52), (40, 13, 0.5), (2000, 1030, 0.5), (5, 6, 0.5)):
        want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1)) if n < 1000 else sum(math.comb(n, j) for j in range(k, n + 1)) / 2**n
        assert one(spark, x=S.binomial_tail(F.lit(k), F.lit(n), p)).x == pytest.approx(want, abs=1e-9)
    # Steps grow with n: three sums for each term would be 10^11 here.
    assert one(spark, x=S.coin_tail(F.lit(100_000), F.lit(200_000))).x == pytest.approx(0.5, abs=2e-3)


def test_coin_tail(spark):
    r = one(spark, a=S.coin_tail(F.lit(3), F.lit(4)), b=S.coin_tail(F.lit(0), F.lit(9)))
    assert r.a == pytest.approx(5 / 16) and r.b == pytest.approx(1)


def test_poisson_weights_average_one(spark):
    mean = spark.range(20000).select(F.avg(stats.poisson_weight(stats.hash_uniform(F.col("id")))).alias("m")).first().m
    assert math.isclose(mean, 1, abs_tol=0.03)


def test_shown_rows_and_rows_by_day_leave_nothing_out(spark):
    from periodica.plans.base import user_days
    from periodica.queries import QUERIES

    d = "/root/testdata/sf0.001"
    total = lambda name: QUERIES[name](spark, d).agg(F.sum("n")).first()[0]
    assert total("op_F21_F23_shown_rows_all_days") == user_days(spark, d).count() > total("op_F21_F23_shown_rows")
    assert total("op_V5_all_rows_by_day") == spark.read.parquet(f"{d}/orders.parquet").count() > total("op_V5_rows_by_day")


def test_a_replay_shows_what_the_stored_log_has_wrong(spark):
    polls = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "c"), (2, 2, "d")], "k int, o int, s string")
    stored = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "x"), (2, 2, "d")], "k int, o int, s string")
    got = {(r.k, r.o): r.side for r in state.replayed(polls, stored, ["k"], ["o"], ["s"]).collect()}
    assert got == {(1, 1): "both", (1, 2): "only_stored", (1, 3): "changed", (2, 1): "only_replayed", (2, 2): "both"}


def test_intervals_stand_around_their_estimates(spark):
    from periodica.queries import QUERIES

    d = "/root/testdata/sf0.001"
    for r in QUERIES["op_M18_rule_intervals"](spark, d).collect():
        assert r.low <= r.difference <= r.high and r.low_a <= r.hits_a / r.n <= r.high_a and r.low_b <= r.hits_b / r.n <= r.high_b
    plain = {r.bucket: r.r for r in QUERIES["op_M16_edge_calibration"](spark, d).collect()}
    for r in QUERIES["op_M16_edge_intervals"](spark, d).collect():
        assert r.r == plain[r.bucket] and r.low <= r.r <= r.high and r.validated == (r.low > 0)


def test_change_logs_hold_no_entity_in_memory(spark, tmp_path):
    from periodica.streaming import streams

    dice = random.Random(2)
    rows = [(1 if dice.random() < 0.4 else dice.randint(2, 20), i, dice.choice("abc"), dice.choice(["x", "y5"])) for i in range(3000)]
    for n in range(3):  # three micro-batches, in order
        spark.createDataFrame(rows[1000 * n : 1000 * (n + 1)], "k long, o long, s string, t string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    log, folded, last, given = [], [], {}, {}
    for k, o, s, t in rows:
        if last.get(k) != s:
            log.append((k, o, s))
        last[k] = s
        if k not in given or s != given[k][0] or (t != given[k][1] and "5" in t):
            folded.append((k, o, s, t))
            given[k] = (s, t)
    schema = "k long, o long, s string, t string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    assert sorted(tuple(r) for r in streams.change_log(stream, "k", "o", "s").collect()) == sorted(log)
    polls = spark.createDataFrame(rows, schema)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    plan = state.change_log_with_text(polls, "k", "o", "s", "t", "5")
    assert sorted(tuple(r) for r in plan.collect()) == sorted(folded)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in plan._jdf.queryExecution().toString()


def test_truncation_guard_raises_beyond_a_key_s_cap(spark):
    from periodica.operators import checks

    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k int, v int")
    assert checks.whole_by(rows, ["k"], 2).count() == 3
    with pytest.raises(checks.Truncated):
        checks.whole_by(rows, ["k"], 1)


def test_hashes_tell_values_nulls_and_columns_apart(spark):
    rows = spark.createDataFrame([("x|b=1:y", "z"), ("x", "y|b=1:z"), ("x", None), ("x", "∅"), ("x", "")], "a string, b string")
    assert rows.select(upsert.content_hash(["a", "b"])).distinct().count() == 5


def test_null_keys_meet(spark):
    schema = "k long, j string, v long"
    old = spark.createDataFrame([(1, None, 5), (None, "a", 6), (2, "b", 7)], schema)
    new = spark.createDataFrame([(1, None, 5), (None, "a", 9), (3, "c", 1)], schema)
    assert {(r.k, r.j): r.action for r in upsert.classify(old, new, ["k", "j"]).collect()} == {(1, None): "same", (None, "a"): "update", (2, "b"): "keep", (3, "c"): "insert"}
    assert {(r.k, r.j): r.v for r in upsert.merged(old, new, ["k", "j"]).collect()} == {(1, None): 5, (None, "a"): 9, (2, "b"): 7, (3, "c"): 1}
    assert upsert.insert_once(old, new, ["k", "j"]).count() == 1
    diff = {r.column: r for r in quality.snapshot_diff(spark.createDataFrame([(1, 2.0, "x"), (2, None, "y")], "id long, n double, t string"), spark.createDataFrame([(1, None, "x"), (2, 3.0, None)], "id long, n double, t string"), ["id"], ["n", "t"]).collect()}
    assert (diff["n"].changed, diff["n"].to_null, diff["n"].from_null, diff["t"].changed, diff["t"].to_null) == (2, 1, 1, 1, 1)


def test_wind_and_grid_follow_their_rules(spark):
    along, across = S.wind_parts(F.lit(10.0), F.lit(240.0), F.lit(60.0))
    calm, _ = S.wind_parts(F.lit(7.9), F.lit(240.0), F.lit(60.0))
    box = lambda lat, lon: S.in_lambert_domain(F.lit(lat), F.lit(lon), 38.5, -97.5, 2697.0, 1587.0)
    r = one(spark, along=along, across=across, calm=calm, south=box(-10.0, -97.5), centre=box(38.5, -97.5), far=box(38.5, 10.0))
    assert (round(r.along, 6), round(r.across, 6), r.calm, r.south, r.centre, r.far) == (10.0, 0.0, None, False, True, False)


def test_guards_raise(spark):
    from periodica.operators import checks
    from periodica.sources.shared import shared_dir

    rows = spark.createDataFrame([(1.0,), (2.5,), (None,)], "k double")
    with pytest.raises(Exception, match="k is fractional"):
        checks.integral_key(rows, "k").collect()
    assert [r.k for r in checks.integral_key(rows.where("k IS NULL OR k = 1"), "k").collect()] == [1, None]
    with pytest.raises(checks.Truncated):
        checks.whole(spark.range(11), 10)
    with pytest.raises(quality.MissingColumns, match="y"):
        quality.require_columns(rows, ["k", "y"])
    years = spark.createDataFrame([(1,), (2,), (3,)], "y int")
    assert upsert.retained(years, F.col("y"), 2).count() == 2
    for horizon, table in ((9, years), (2, years.union(spark.createDataFrame([(None,)], "y int")))):
        with pytest.raises(ValueError):
            upsert.retained(table, F.col("y"), horizon)
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_solver_reaches_the_fixed_point(spark):
    dice = random.Random(5)
    rows = [(g, a, b, float(dice.randint(50, 150)), float(dice.randint(5, 15))) for g in (1, 2) for a in range(6) for b in range(6) if a != b]
    pairs = spark.createDataFrame(rows, "g int, entity int, counterparty int, num double, den double")
    got = rating.solved(pairs, ["g"], 10.0, 1e-9)
    arm = rating.arms(pairs, ["g"])
    again = rating.iterate(arm, got, ["g"], 10.0).withColumnRenamed("value", "again")
    assert got.count() == 24 and got.join(again, ["g", "id", "side"]).agg(F.max(F.abs(F.col("value") - F.col("again"))).alias("m")).first().m < 1e-7


def test_verdicts_of_a_summary(spark):
    rows = spark.createDataFrame([("all", i < 80) for i in range(100)] + [("few", True)] * 5 + [("even", i % 2 == 0) for i in range(100)], "slice string, hit boolean")
    got = {(r.slice, r.metric): r for r in stats.summary_of_rates(rows, "slice", F.col("hit"), F.lit(True), 0.5, 30, {"all": 1, "even": 1}).collect()}
    assert [got[s, "win_rate"].verdict for s in ("all", "few", "even")] == ["supported", "insufficient_n", "ci_spans_null"]
    assert (got["all", "tests"].n, got["all", "tests"].estimate) == (2, 1.0)


def walked(rows, sticky_state, floor=0.5):
    """Plain walk through each source's polls: log rows and verdicts."""
    log, verdicts = [], []
    for src in sorted({r[0] for r in rows}):
        active, misses, said = {}, {}, {}
        for poll in sorted({r[2] for r in rows if r[0] == src}):
            present = {r[1]: r[3] for r in rows if r[0] == src and r[2] == poll}
            expected = sum(k in present or s != sticky_state for k, s in active.items())
            out = len(present) < floor * expected
            verdicts.append((src, poll, len(present), expected, out))
            for k, s in present.items():
                if k not in said:
                    log.append((src, k, poll, "first", s))
                elif said[k] is None:
                    log.append((src, k, poll, "relisted", s))
                elif said[k] != s:
                    log.append((src, k, poll, "changed", s))
                said[k] = active[k] = s
            if out:
                continue
            for k in list(active):
                misses[k] = 0 if k in present else misses.get(k, 0) + 1
                if misses[k] >= 2 and active[k] != sticky_state:
                    log.append((src, k, poll, "cleared", None))
                    said[k] = None
                    del active[k], misses[k]
    return sorted(log, key=repr), sorted(verdicts)


@pytest.mark.parametrize("seed", range(3))
def test_guarded_log_equals_a_plain_walk(spark, seed):
    from periodica.operators import state as ST

    dice = random.Random(seed)
    rows = []
    for src in (0, 1):
        for poll in range(0, 60, 2):  # numbers needn't be consecutive
            share = dice.choice([0.9, 0.7, 0.5, 0.1])
            rows += [(src, k, poll, dice.choice("abc")) for k in range(25) if dice.random() < share and (k + poll // 14) % 5]
    log, verdicts = ST.guarded_log(spark.createDataFrame(rows, "src int, key long, poll int, state string").repartition(3), F.col("state") == "c")
    want_log, want_verdicts = walked(rows, "c")
    assert sorted(map(tuple, verdicts.collect())) == want_verdicts and any(v[4] for v in want_verdicts)
    assert sorted(map(tuple, log.collect()), key=repr) == want_log


def test_streamed_guarded_log_equals_a_plain_walk_and_refuses_late_polls(spark, tmp_path):
    from periodica.streaming import streams

    dice = random.Random(8)
    schema, rows = "src int, key long, poll int, state string", []
    for src in (0, 1, 2):
        for poll in range(0, 60, 2):
            if src == 2 and 20 <= poll < 40:  # a source without polls in the second run
                continue
            share = dice.choice([0.9, 0.7, 0.5, 0.1])
            rows += [(src, k, poll, dice.choice("abc")) for k in range(20) if dice.random() < share and (k + poll // 14) % 5]
    source, folder = str(tmp_path / "polls"), str(tmp_path / "log")
    for low in (0, 20, 40):
        spark.createDataFrame([r for r in rows if low <= r[2] < low + 20], schema).write.mode("append").parquet(source)
        log, verdicts = streams.guarded_log(spark.readStream.schema(schema).parquet(source), F.col("state") == "c", folder)
        want_log, want_verdicts = walked([r for r in rows if r[2] < low + 20], "c")
        assert sorted(map(tuple, verdicts.collect())) == want_verdicts
        assert sorted(map(tuple, log.collect()), key=repr) == want_log
    assert any(v[4] for v in want_verdicts) and {r[3] for r in want_log} == {"first", "changed", "relisted", "cleared"}
    spark.createDataFrame([(1, 3, 30, "a")], schema).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="behind poll 58"):
        streams.guarded_log(spark.readStream.schema(schema).parquet(source), F.col("state") == "c", folder)
    assert spark.read.parquet(f"{folder}/log").count() == len(want_log)


def test_sticky_states_outlast_absence_and_leave_the_guard(spark):
    from periodica.operators import state as ST

    rows = [(0, k, 0, "out") for k in range(6)] + [(0, k, p, "in") for k in (10, 11) for p in range(6)] + [(0, 12, 0, "in")]
    log, verdicts = ST.guarded_log(spark.createDataFrame(rows, "src int, key long, poll int, state string"), F.col("state") == "out")
    assert [tuple(r)[1:] for r in log.where("action = 'cleared'").collect()] == [(12, 2, "cleared", None)]
    # Six sticky entities are absent, and two of two or three others are there: no outage.
    assert [(r.poll, r["size"], r.expected, r.out) for r in verdicts.orderBy("poll").collect()][1:4] == [(1, 2, 3, False), (2, 2, 3, False), (3, 2, 2, False)]
    empty = spark.createDataFrame([], "src int, key long, poll int, state string")
    log, verdicts = ST.guarded_log(empty, F.lit(False))
    assert log.count() == verdicts.count() == 0


def test_retention_deletes_files_as_planned_and_refuses_otherwise(spark, tmp_path, monkeypatch):
    from periodica.operators import retention

    path, schema = str(tmp_path / "t"), "v long, y int"
    rows = [(k, 2020 + k % 4) for k in range(40)]
    retention.create(spark.createDataFrame(rows, schema), path, "y")
    on_disk = lambda: spark.read.schema(schema).parquet(f"{path}/data").count()
    with pytest.raises(ValueError, match="emptied"):
        retention.apply(spark, path, schema, "y", 2030)
    # A count that isn't as planned: the version before is live again, and no file is gone.
    count = retention.read
    with monkeypatch.context() as m:
        m.setattr(retention, "read", lambda s, p, k: count(s, p, k).where("v <> 3 or y <> 2023") if len(retention.live(s, p)) < 4 else count(s, p, k))
        with pytest.raises(ValueError, match="planned"):
            retention.apply(spark, path, schema, "y", 2022)
    assert on_disk() == retention.read(spark, path, schema).count() == 40
    plan = retention.apply(spark, path, schema, "y", 2022)
    assert sorted(map(tuple, plan.collect())) == [(2020, 10, True), (2021, 10, True), (2022, 10, False), (2023, 10, False)]
    assert on_disk() == retention.read(spark, path, schema).count() == 20 and sorted(p.name for p in (tmp_path / "t/data").iterdir() if "=" in p.name) == ["y=2022", "y=2023"]
    assert retention.apply(spark, path, schema, "y", 2000).where("goes").count() == 0
    retention.create(spark.createDataFrame([(1, None), (2, 2024)], schema), path + "-unknown", "y")
    with pytest.raises(ValueError, match="no epoch"):
        retention.apply(spark, path + "-unknown", schema, "y", 2023)
