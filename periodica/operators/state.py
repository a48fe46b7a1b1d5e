"""Change-logs and presence from polled feeds, in batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.sources.shared import shared_dir


def change_log(polls: DataFrame, keys: list[str], order: list[str], tracked: list[str]) -> DataFrame:
    """Rows at which an entity is first seen or a tracked field changes."""
    w = Window.partitionBy(*keys).orderBy(*order)
    was = F.lag(F.struct(*tracked)).over(w)
    return polls.withColumn("_was", was).where(F.col("_was").isNull() | ~F.struct(*tracked).eqNullSafe(F.col("_was"))).drop("_was")


def replayed(polls: DataFrame, stored: DataFrame, keys: list[str], order: list[str], tracked: list[str]) -> DataFrame:
    """The log rebuilt from all polls beside the stored one: keys, order and side (both, only_stored, only_replayed or changed)."""
    at = [*keys, *order]
    a = stored.select(*at, F.struct(*tracked).alias("_stored"))
    b = change_log(polls, keys, order, tracked).select(*at, F.struct(*tracked).alias("_replayed"))
    side = F.when(F.col("_replayed").isNull(), "only_stored").when(F.col("_stored").isNull(), "only_replayed").when(F.col("_stored").eqNullSafe(F.col("_replayed")), "both").otherwise("changed")
    return a.join(b, at, "full").select(*at, side.alias("side"))


def change_log_with_text(polls: DataFrame, key: str, order: str, state: str, text: str, pattern: str) -> DataFrame:
    """Emits on first sight, on a changed state, and on a changed text that matches the pattern.

    The comparison is with the last row emitted, so a skipped text stays stale: an order-dependent fold. Rows are
    sorted by entity and order on disk and folded batch by batch; one row of state is carried, so no worker holds
    an entity's rows.
    """
    import re

    wanted = re.compile(pattern)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, last = None, None
        for batch in batches:
            kept = []
            for i, (k, s, t) in enumerate(zip(*[batch.column(c).to_pylist() for c in (key, state, text)], strict=True)):
                if last is None or k != entity or s != last[0] or (t != last[1] and wanted.search(t or "")):
                    kept.append(i)
                    entity, last = k, (s, t)
            yield batch.take(pa.array(kept, pa.int64()))

    rows = polls.select(key, order, state, text)
    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(fold, rows.schema)


def poll_numbers(polls: DataFrame, source: str, at: str, floor: float = 0.5) -> DataFrame:
    """Numbers each source's polls; a poll smaller than `floor` of its source's mean so far is an outage and gets none.

    One row a poll: outages are found from counts alone, before any entity is looked at.
    """
    sizes = polls.groupBy(source, at).agg(F.count("*").alias("size"))
    before = Window.partitionBy(source).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("usual", F.avg("size").over(before)).where(F.col("usual").isNull() | (F.col("size") >= floor * F.col("usual")))
    return sizes.select(source, at, F.row_number().over(Window.partitionBy(source).orderBy(at)).alias("poll"))


def absences(polls: DataFrame, numbers: DataFrame, source: str, key: str, at: str, sticky: Column, misses: int = 2) -> DataFrame:
    """Clears: an entity missed `misses` polls of its source in a row; the row stands at the poll that completes them.

    Poll numbers leave outages out, so presence there neither adds nor resets misses. Sticky states never clear.
    """
    last = numbers.groupBy(source).agg(F.max("poll").alias("last_poll"))
    seen = polls.join(numbers, [source, at]).withColumn("sticky", sticky)
    following = F.lead("poll").over(Window.partitionBy(source, key).orderBy("poll"))
    gaps = seen.join(last, source).withColumn("until", F.coalesce(following, F.col("last_poll") + 1))
    cleared = gaps.where(((F.col("until") - F.col("poll") - 1) >= misses) & ~F.col("sticky")).select(source, key, (F.col("poll") + misses).alias("poll"))
    return cleared.join(numbers, [source, "poll"]).select(source, key, "poll", F.col(at).alias("cleared_at"))


def presence(polls: DataFrame, numbers: DataFrame, source: str, key: str, at: str) -> DataFrame:
    """Last poll an entity was in and how many its source has taken since."""
    last = numbers.groupBy(source).agg(F.max("poll").alias("last_poll"))
    seen = polls.join(numbers, [source, at]).groupBy(source, key).agg(F.max("poll").alias("seen_poll"))
    return seen.join(last, source).select(source, key, "seen_poll", (F.col("last_poll") - F.col("seen_poll")).alias("misses"))


def resolved(latest: DataFrame, key: str, source: str, prefer: str, flagged: Column, at: str) -> DataFrame:
    """One row an entity over its sources' latest rows: flagged if any is; the preferred source's time if it has one, else the newest."""
    return latest.withColumn("_f", flagged).groupBy(key).agg(F.max(F.col("_f").cast("int")).alias("flagged"), F.count("*").alias("sources"), F.coalesce(F.max(F.when(F.col(source) == prefer, F.col(at))), F.max(at)).alias("as_of"))


def with_evidence(latest: DataFrame, active: DataFrame, key: str, first: str) -> DataFrame:
    """One state for each entity out of what its sources say last, where a held state yields to evidence.

    latest is (key, source, state, seen, stale), one row for an entity and source; a null state is none. active is (key, active): when an entity was last seen to
    act, null or absent if never. The first source's state goes before the others', of which the first name with a state
    counts. A stale state of the first source (held past its misses) is dropped if any other source has a row, with or without a state, or if the entity acted after it was
    last seen; else it stands, and stale_since says since when. The rule is `fresh`, `other`, `none`, `stands`, `yields` (to another source) or `acted`.

    Two groupings and a join on the entity; an entity has a row a source.
    """
    is_first = F.col("source") == first
    per = latest.groupBy(key).agg(F.max(F.when(is_first, F.struct("state", "seen", "stale"))).alias("one"), F.count_if(~is_first).alias("others"), F.min(F.when(~is_first & F.col("state").isNotNull(), F.struct("source", "state"))).alias("other"))
    last = active.groupBy(key).agg(F.max("active").alias("active"))
    stale = F.coalesce(F.col("one.stale") & F.col("one.state").isNotNull(), F.lit(False))
    acted = F.coalesce(F.col("active") > F.col("one.seen"), F.lit(False))
    held = F.col("one.state").isNotNull() & ~(stale & ((F.col("others") > 0) | acted))
    rule = F.when(held & stale, "stands").when(held, "fresh").when(stale & (F.col("others") > 0), "yields").when(stale, "acted").when(F.col("other").isNotNull(), "other").otherwise("none")
    return per.join(last, key, "left").select(
        key, F.when(held, F.col("one.state")).otherwise(F.col("other.state")).alias("state"), F.when(held, first).otherwise(F.col("other.source")).alias("source"),
        F.when(held & stale, F.col("one.seen")).alias("stale_since"), rule.alias("rule"),
    )


def _sightings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds (src, key, poll, state, sticky, out, n, n_last, base, gone), sorted by entity and poll, to one row a sighting.

    n numbers the polls that count, up to and with this one. A sighting gets its action (first, changed, relisted or
    none), the number of the poll that clears the entity before its next sighting, and the next sighting's poll.
    What is carried is one sighting: its row, its last written state and the count from which misses run (base). A row that
    comes with a base is an entity's last sighting of an earlier run: it was told then and has no action; gone says that its clearing was told too.
    """
    names = _SEEN.names
    held = None  # row, action, base: misses at a poll of number m are m - base

    def closed(following: tuple | None) -> tuple:
        row, action, base = held
        src, key, poll, state, sticky, _, n, n_last, _, gone = row
        same = following is not None and following[:2] == row[:2]
        until = (following[6] - (not following[5])) if same else n_last
        clear = max(base + MISSES, n + 1)
        return src, key, poll, state, action, clear if not sticky and clear <= until else None, following[2] if same else None, sticky, n, base, gone

    for batch in batches:
        out = []
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held is not None:
                out.append(done := closed(row))
            same = held is not None and held[0][:2] == row[:2]
            cleared = same and done[5] is not None
            action = None if row[8] is not None else "first" if not same else "relisted" if cleared else "changed" if row[3] != held[0][3] else None
            # A poll that is an outage neither adds to misses nor ends them.
            base = row[8] if row[8] is not None else held[2] if same and not cleared and row[5] else row[6]
            held = row, action, base
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=_SEEN)
    if held is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, closed(None), strict=True))], schema=_SEEN)


MISSES = 2
_SEEN = pa.schema([
    ("src", pa.int32()), ("key", pa.int64()), ("poll", pa.int32()), ("state", pa.string()), ("action", pa.string()), ("clear_n", pa.int64()), ("next_poll", pa.int32()), ("sticky", pa.bool_()),
    ("n", pa.int64()), ("base", pa.int64()), ("gone", pa.bool_()),
])
_SEEN_SQL = "src int, key long, poll int, state string, action string, clear_n long, next_poll int, sticky boolean, n long, base long, gone boolean"

#: What a run leaves to the next one: each entity's last sighting, and each source's counted polls and newest poll.
HELD = "src int, key long, poll int, state string, sticky boolean, n long, base long, gone boolean"
COUNTS = "src int, n0 long, newest int"


def guarded_log(polls: DataFrame, sticky: Column, floor: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The log of polled states with clears, and the verdict on each poll. polls is (src int, key long, poll int, state string), one row a sighting.

    A poll is an outage if it holds fewer than `floor` of the entities that it should hold: those active before it, less
    sticky ones that are absent from it. In an outage nothing is cleared and no misses are counted, but its rows count as sightings. Otherwise
    an active entity that misses MISSES polls in a row is cleared, unless its state is sticky; a sticky one stays, and its misses go on.
    """
    spark = polls.sparkSession
    log, verdicts, _, _ = guarded_step(polls, sticky, spark.createDataFrame([], HELD), spark.createDataFrame([], COUNTS), floor)
    return log, verdicts


def guarded_step(polls: DataFrame, sticky: Column, held: DataFrame, counts: DataFrame, floor: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One run of the guarded log over new polls, behind what earlier runs held (HELD) and counted (COUNTS): log rows, verdicts, and both for the next run.

    New polls must be whole and later than all earlier ones of their source; then runs over parts give the rows of one run over all.

    Whether a poll is an outage depends on earlier verdicts only, through what is still active. So no source is walked through in one task: all
    entities are folded under assumed verdicts, the expected size of each poll is summed from the folds, and this is repeated until the verdicts
    stand. Each round settles at least one more outage, so rounds are at most one more than a source's outages; a round reads the sightings once, in place,
    and shuffles one sum for each poll.
    """
    shared_dir(polls.sparkSession)
    rows = polls.select("src", "key", "poll", "state", sticky.alias("sticky"))
    rows = rows.repartition("src", "key").sortWithinPartitions("src", "key", "poll").checkpoint()
    sizes = rows.groupBy("src", "poll").agg(F.count("*").alias("size")).withColumn("out", F.lit(False)).checkpoint()
    by_source = Window.partitionBy("src").orderBy("poll")
    while True:
        counted = sizes.join(counts, "src", "left").withColumn("n", F.coalesce("n0", F.lit(0)) + F.sum((~F.col("out")).cast("long")).over(by_source))
        counted = counted.withColumn("n_last", F.max("n").over(Window.partitionBy("src"))).drop("n0", "newest").checkpoint()
        ends = counted.groupBy("src").agg(F.max("n").alias("n_new"), F.max("poll").alias("newest_new")).join(counts, "src", "full")
        ends = ends.select("src", F.coalesce("n_new", "n0").alias("n0"), F.coalesce("newest_new", "newest").alias("newest"))
        flagged = rows.join(counted.select("src", "poll", "out", "n", "n_last"), ["src", "poll"]).select("src", "key", "poll", "state", "sticky", "out", "n", "n_last", F.lit(None).cast("long").alias("base"), F.lit(False).alias("gone"))
        before = held.join(ends, "src").select("src", "key", "poll", "state", "sticky", F.lit(False).alias("out"), "n", F.col("n0").alias("n_last"), "base", "gone")
        # Broadcast or not, the join's rows are brought together by entity again; where it was broadcast this is a sort in place.
        seen = flagged.unionByName(before).repartition("src", "key").sortWithinPartitions("src", "key", "poll").mapInArrow(_sightings, _SEEN_SQL).checkpoint()
        at = counted.where(~F.col("out")).select("src", F.col("n").alias("clear_n"), F.col("poll").alias("clear_poll"))
        timed = seen.join(at, ["src", "clear_n"], "left")
        # A sighting is expected in the polls after it up to its clearing or the next sighting; while sticky, at the next sighting only.
        last = F.coalesce("clear_poll", "next_poll")
        steps = timed.where("NOT gone").select("src", F.explode(F.filter(F.array(
            F.struct(F.when(F.col("sticky"), F.col("next_poll")).otherwise(F.col("poll") + 1).alias("poll"), F.lit(1).alias("step")),
            F.struct((F.when(F.col("sticky"), F.col("next_poll")).otherwise(last) + 1).alias("poll"), F.lit(-1).alias("step")),
        ), lambda x: x.poll.isNotNull())).alias("x")).groupBy("src", "x.poll").agg(F.sum("x.step").alias("step"))
        # Steps may fall between polls of a source; a union brings them into its order.
        ordered = sizes.select("src", "poll", "size", "out", F.lit(0).cast("long").alias("step")).unionByName(steps.select("src", "poll", F.lit(None).cast("long").alias("size"), F.lit(None).cast("boolean").alias("out"), "step"))
        expected = F.sum("step").over(by_source.rangeBetween(Window.unboundedPreceding, 0))
        judged = ordered.withColumn("expected", expected).where("size is not null").withColumn("was", F.col("out")).withColumn("out", F.col("size") < floor * F.col("expected")).checkpoint()
        if judged.where("out <> was").isEmpty():
            break
        sizes = judged.select("src", "poll", "size", "out")
    logged = timed.where("action is not null").select("src", "key", "poll", "action", "state")
    cleared = timed.where("clear_poll is not null").select("src", "key", F.col("clear_poll").alias("poll"), F.lit("cleared").alias("action"), F.lit(None).cast("string").alias("state"))
    left = seen.where("next_poll is null").select("src", "key", "poll", "state", "sticky", "n", "base", F.col("clear_n").isNotNull().alias("gone"))
    return logged.unionByName(cleared), judged.select("src", "poll", "size", "expected", "out"), left, ends
