"""Exact quantiles, match features, venue files and hourly documents on small cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodica.operators import joins, quality
from periodica.operators.selection import quantiles
from periodica.sources import readers


def test_quantiles_of_skewed_and_tied_groups(spark):
    dice = random.Random(3)
    rows = [("hot", dice.gauss(0, 50)) for _ in range(4000)] + [("tied", float(dice.randint(0, 3))) for _ in range(500)] + [(f"g{k}", float(k * j)) for k in range(40) for j in range(k)]
    rows += [(None, float(j)) for j in range(8)] + [("one", 7.0), ("gone", None), ("hot", None)]
    at = [0.0, 1 / 3, 0.5, 0.975, 1.0]
    got = {r.g: list(r)[1:] for r in quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", at).collect()}
    want = {g: np.quantile([v for h, v in rows if h == g and v is not None], at) for g in {g for g, v in rows if v is not None}}
    assert set(got) == set(want)
    for g in want:
        assert np.allclose(got[g], want[g], atol=1e-9), g


def test_quantiles_weigh_rows_and_take_empty_tables(spark):
    rows = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1), ("b", 2.0, 1)], "g string, v double, n long")
    assert sorted(map(tuple, quantiles(rows, ["g"], "v", [0.5, 0.9], F.col("n")).collect())) == [("a", 1.0, pytest.approx(1 + 4 * 0.7)), ("b", 2.0, 2.0)]
    assert quantiles(rows.where("false"), ["g"], "v", [0.5]).count() == 0


def test_one_hot_group_is_selected_in_many_tasks(spark):
    """One group with all rows, parted by value into as many ranges as there are shuffle partitions."""
    rows = spark.range(20000).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert quantiles(rows, ["g"], "v", [0.25, 0.75]).first()[1:] == (19999 * 0.25, 19999 * 0.75)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


SIGNALS = "epoch int, entity string, signal string, value double, stability double"


def signals_of(*teams):
    return [(1, t, f"{b}_{u}", float(i + 10 * j), 0.5 + i / 10) for i, t in enumerate(teams) for j, (b, u) in enumerate([("x", "off"), ("x", "def")])]


def test_match_features_centre_both_sides_and_keep_gaps(spark):
    matches = spark.createDataFrame([(1, "a", "b", "Home"), (1, "b", "c", "Neutral"), (1, "a", "z", "Home")], "epoch int, home string, away string, location string")
    got = {(r.home, r.away): r for r in joins.match_features(matches, spark.createDataFrame(signals_of("a", "b", "c"), SIGNALS), ["epoch"], ["x"]).collect()}
    ab = got["a", "b"]
    assert (ab.home_off__x, ab.home_off_raw__x, ab.away_def__x, ab.away_def_raw__x, ab.h_home, ab.features_complete, ab.stability_min) == (-1.0, 0.0, 0.0, 11.0, 0.5, True, 0.5)
    assert got["b", "c"].h_home == 0.0
    az = got["a", "z"]
    assert az.away_off__x is None and not az.features_complete and az.stability_min is None and az.home_off__x == -1.0


def test_match_features_refuse_fan_out_and_unknown_places(spark):
    schema = "epoch int, home string, away string, location string"
    twice = spark.createDataFrame([*signals_of("a", "b"), (1, "a", "x_off", 3.0, 0.1)], SIGNALS)
    with pytest.raises(Exception, match="two rows of signal x_off"):
        joins.match_features(spark.createDataFrame([(1, "a", "b", "Home")], schema), twice, ["epoch"], ["x"]).collect()
    for place in ("Moon", None):
        with pytest.raises(Exception, match="Home or Neutral"):
            joins.match_features(spark.createDataFrame([(1, "a", "b", place)], schema), spark.createDataFrame(signals_of("a"), SIGNALS), ["epoch"], ["x"]).collect()


VENUES = "id string, names string, lat double, lon double, roof string, bearing_basis string, bearing double, outline long, zone string"


def venue(tmp_path, spark, *lines, header="id,names,lat,lon,roof,bearing_basis,bearing,outline,zone"):
    path = tmp_path / f"v{random.random()}.csv"
    path.write_text("\n".join([header, *lines]) + "\n")
    v = readers.checked_header_csv(spark, str(path), VENUES, ("names",))
    return quality.row_faults(v, "id", readers.venue_rules(("agrees", "none"), ("agrees",), ("open", "fixed")))


def test_venue_files_name_each_fault_and_are_refused(spark, tmp_path):
    good = "a,Old|New,40,-74,open,agrees,0,7,America/New_York"
    faults = {
        "b,|,40,-74,open,agrees,0,7,UTC": ["names"], "c,n,90.5,0,open,agrees,0,7,UTC": ["coordinates"], "d,n,0,-181,tent,agrees,0,7,UTC": ["coordinates", "roof"],
        "e,n,0,0,open,guess,,,UTC": ["basis"], "f,n,0,0,open,agrees,180,7,UTC": ["bearing_range"], "g,n,0,0,open,agrees,5,,UTC": ["bearing_iff_basis"],
        "h,n,0,0,open,none,5,7,UTC": ["bearing_iff_basis"], "i,n,0,0,open,none,,,Mars/Olympus": ["zone"], "j,n,,0,open,none,,,": ["coordinates", "zone"],
        ",n,0,0,open,none,,,UTC": ["no_key"],
    }
    got = {r.id: r.faults for r in venue(tmp_path, spark, good, *faults).collect()}
    assert got == {"a": []} | {line.split(",")[0] or None: f for line, f in faults.items()}
    assert [r.names for r in quality.refuse_faults(venue(tmp_path, spark, good), "id").collect()] == [["Old", "New"]]
    with pytest.raises(quality.FaultyRows, match="2 rows; a: duplicate_key"):
        quality.refuse_faults(venue(tmp_path, spark, good, good), "id")
    with pytest.raises(Exception):  # noqa: B017 - Spark's own error for a foreign header
        venue(tmp_path, spark, good, header="id,names,lon,lat,roof,bearing_basis,bearing,outline,zone").collect()


def test_hourly_documents_are_held_against_the_hours_asked_for(spark):
    ok = '{"units":{"time":"iso8601","w":"mp/h","g":"mp/h"},"hourly":{"time":["2024-03-09T23:00","2024-03-10T00:00"],"w":[1,2],"g":[null,5]}}'
    cases = {
        "ok": ok, "units": ok.replace('"w":"mp/h"', '"w":"km/h"'), "variables": ok.replace(',"g":[null,5]', ""), "short": ok.replace('"g":[null,5]', '"g":[5]'), "late": ok.replace("T23:00", "T22:00"),
        "early_end": ok.replace(',"2024-03-10T00:00"', "").replace("[1,2]", "[1]").replace("[null,5]", "[5]"), "no_data": ok.replace("[1,2]", "[1,null]"), "malformed": ok[:50], "null": None,
    }
    docs = spark.createDataFrame([(k, v, "2024-03-09 23:40:00") for k, v in cases.items()], "k string, doc string, at string").withColumn("at", F.col("at").cast("timestamp"))
    rows = readers.hourly_rows(docs, "doc", readers.expected_hours(F.col("at"), 2), {"w": "mp/h", "g": "mp/h"}, ("w",)).collect()
    assert {r.k: r.verdict for r in rows} == {"ok": "ok", "units": "units", "variables": "variables", "short": "variables", "late": "hours", "early_end": "hours", "no_data": "no_data", "malformed": "malformed", "null": "malformed"}
    assert [(r.hour_offset, r.valid_time, r.w, r.g) for r in rows if r.k == "ok"] == [(0, "2024-03-09T23:00", 1.0, None), (1, "2024-03-10T00:00", 2.0, 5.0)]


def test_shrinkage_comes_from_parents_and_the_fallback_cohort(spark):
    from periodica.operators import registry as G

    ms = [G.Metric("part", "f", "1", "1", 9.0, 0.9, parent="whole"), G.Metric("whole", "f", "1", "1", 5.0, 0.5), G.Metric("other", "f", "1", "1", 7.0, 0.7)]
    known = {("whole", "x"): (1.0, 0.1), ("whole", "y"): (2.0, 0.2), ("part", "y"): (3.0, 0.3)}
    got = G.resolved_shrinkage(ms, known, "x")
    assert got == {("part", "x"): (1.0, 0.1), ("part", "y"): (3.0, 0.3), ("whole", "x"): (1.0, 0.1), ("whole", "y"): (2.0, 0.2), ("other", "x"): (7.0, 0.7), ("other", "y"): (7.0, 0.7)}
    rows = spark.createDataFrame([("part", "y"), ("part", "z"), ("whole", None)], "metric string, cohort string").withColumns({"k": F.lit(0.0), "r": F.lit(0.0)})
    assert [(r.metric, r.k, r.r) for r in G.shrunk_by_cohort(rows, got, "cohort", "x").collect()] == [("part", 3.0, 0.3), ("part", 1.0, 0.1), ("whole", 1.0, 0.1)]
    with pytest.raises(ValueError, match="circle"):
        G.resolved_shrinkage([G.Metric("a", "f", "1", "1", 1.0, 0.0, parent="b"), G.Metric("b", "f", "1", "1", 1.0, 0.0, parent="a")], {}, "x")


def test_roles_sum_different_things():
    from periodica.operators import registry as G

    lists = [set(v.items()) for v in G.ROLES.values()]
    assert all(len(a & b) < len(a) / 2 for a in lists for b in lists if a is not b)
