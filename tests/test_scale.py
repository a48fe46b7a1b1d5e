"""Plans and exact forms that only matter on larger tables: what is read once, what is shuffled, how a window runs."""

import hashlib
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from periodica.operators import joins, registry, stats
from periodica.queries import QUERIES
from periodica.streaming import streams

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fingerprint_rounds_the_binary_value(spark):
    # Numbers of ten decimals that end in five: their shortest form is a tie, their value is not.
    numbers = [k / 128_000 for k in range(1, 4000, 2)] + [None, 0.0, -1.5, 2.0**70]
    half_up = lambda x: str(Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    assert any(f"{x:.9f}" != half_up(x) for x in numbers[:-4])
    rows = [f"v={'null' if x is None else f'{x:.9f}'}" for x in numbers]
    want = sum(int(hashlib.md5(r.encode()).hexdigest()[:12], 16) for r in rows)
    got = stats.fingerprint(spark.createDataFrame([(1, x) for x in numbers], "k int, v double"), ["k"], ["v"], []).first()
    assert (got.n, got.hash_sum) == (len(numbers), str(want))


def test_next_candidate_goes_through_a_slot_once(spark):
    dice = random.Random(5)
    rows = [(dice.choice([1, 2, None]), k, k, dice.random() < 0.6) for k in range(200)]
    out = joins.next_candidate(spark.createDataFrame(rows, "slot int, rank int, member int, flagged boolean"), ["slot"], "rank", "member", F.col("flagged"))
    want = []
    for slot, rank, member, flagged in rows:
        if flagged:
            behind = [r for r in rows if r[0] == slot and r[1] > rank and not r[3]]
            want.append((slot, member, rank, behind[0][2] if behind else None, behind[0][1] - rank if behind else None))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert "unboundedfollowing" not in plan_of(out)


@pytest.mark.parametrize("name", ["op_M13_projected_scores", "op_M3_combined_discounts", "op_M3_continuity_discounts", "op_M4_three_way_blend", "op_M5_cohort_blend", "op_M5_registry_blend"])
def test_lines_are_summed_once(spark, name):
    assert "lineitem" not in plan_of(QUERIES[name](spark, DATA))


def test_roles_are_assembled_from_narrow_rows(spark):
    rows = spark.createDataFrame([(1, 7, 7, None, 2000, 2, 40, 6000000, 8, "R", "O", 1, True), (1, 8, 7, 7, 2000, 3, 1, 100, 0, "A", "F", 2, None)], "segment int, supp long, cust long, part long, epoch int, n int, qty long, cents long, disc int, kind string, status string, step int, c boolean")
    out = registry.assembled(rows, {"supplier": "supp", "customer": "cust", "part": "part"}, ["epoch"], F.col("c"))
    got = {r.id: r for r in out.collect()}
    assert (got[7].supplier_rows, got[7].customer_rows, got[7].part_rows, got[8].part_rows) == (1, 2, 1, None)
    assert (got[7].customer_cents, got[7].customer_charted, got[8].supplier_charted, got[8].supplier_charted_deep, got[7].supplier_charted_deep) == (6000100, 1, None, None, 1)
    # Rows are shuffled before they are summed, and only then.
    plan = plan_of(out).split("Initial Plan")[-1]
    assert plan.count("hashpartitioning(") == 1 and plan.index("Aggregate") < plan.index("hashpartitioning(") and "partial_sum" not in plan[plan.index("hashpartitioning(") :]


def test_streamed_locks_give_each_start_once_and_drop_late_runs(spark, tmp_path):
    hour, schema = 3_600_000_000, "user_id long, start long, at long, id long"
    one, two = 1000 * hour, 1100 * hour
    batches = [
        [(1, one, one - 50 * hour, 1), (1, one, one - 3 * hour, 2), (2, one, one - 60 * hour, 3), (4, one, None, 4), (5, None, one, 5)],
        # An earlier run than the one held, a start that is passed, a run after its start, a null key.
        [(1, one, one - 3 * hour, 0), (3, two, one + hour, 7), (1, one, one + 2, 8), (None, one, one - 4 * hour, 9)],
        # Late runs for a lock given out and for an open start; an earlier id at the time held.
        [(1, one, one - 40 * hour, 10), (3, two, one - 2 * hour, 11), (3, two, two - hour, 6)],
        [(6, 2000 * hour, 1900 * hour, 12), (3, two, two + 1, 13)],
    ]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r.user_id or 0, r.kind, r.id) for r in streams.locks(rows, ["user_id"], 48).collect())
    # 9 lies behind the mark of the first micro-batch, ten minutes before its newest run.
    assert got == [(1, "locked", 0), (1, "rejected", 8), (2, "missed", None), (3, "locked", 6), (3, "rejected", 13)]
