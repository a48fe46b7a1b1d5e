"""Locks: the first run inside a window before a start is kept for good; what comes later is refused."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000_000
_OUT = "kind string, id long"
_HELD = "at long, id long"


def locks(runs: DataFrame, keys: list[str], lead: int, closed: int | None = None) -> DataFrame:
    """Rows (keys, start, kind, id) of runs (keys, start long, at long, id long), times in microseconds.

    A start that has passed (before `closed`; null: all) is `locked` by the earliest run, by (at, id), of the `lead` hours before it, or `missed`
    (id null) if it had runs before it but none in them. Runs at or after their start are `rejected`, one row each. Rows without a time or a start are ignored; a
    start that is moved is another one. One grouping with map-side minimum.
    """
    runs = runs.where("at is not null and start is not null")
    inside = (F.col("at") >= F.col("start") - lead * HOUR) & (F.col("at") < F.col("start"))
    first = runs.where("at < start").groupBy(*keys, "start").agg(F.min(F.when(inside, F.struct("at", "id"))).alias("first"))
    if closed is not None:
        first = first.where(F.col("start") < closed)
    kept = first.select(*keys, "start", F.when(F.col("first").isNull(), "missed").otherwise("locked").alias("kind"), F.col("first.id").alias("id"))
    return kept.unionByName(runs.where("at >= start").select(*keys, "start", F.lit("rejected").alias("kind"), "id"))


def lock_timers(runs: DataFrame, keys: list[str], lead: int) -> DataFrame:
    """The same rows out of a stream that has a watermark: each start is a timer that gives its lock once, when the watermark passes it.

    What is held for a start is the earliest run so far, and nothing after the timer. A run that comes behind the watermark is dropped before it gets here,
    so a lock that was given out can't change; one at or after its start touches no state. Starts that the watermark hasn't passed are still open.
    """
    names = [*keys, "start"]
    kinds = dict(runs.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in names], _OUT])

    def given(key: tuple, kind: str, ids: list) -> pd.DataFrame:
        out = pd.DataFrame({k: [v] * len(ids) for k, v in zip(names, key, strict=True)})
        return out.assign(kind=kind, id=pd.array(ids, "Int64"))

    def fold(key: tuple, chunks: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        start = int(key[-1])
        held = timer.get if timer.exists else None
        lock = lambda: given(key, "missed" if held[1] is None else "locked", [held[1]])
        if held is not None and (timer.hasTimedOut or timer.getCurrentWatermarkMs() > start // 1000):
            yield lock()
            timer.remove()
            held = None
        for chunk in chunks:
            after = chunk[chunk["at"] >= start]
            if len(after):
                yield given(key, "rejected", after["id"].tolist())
            before = chunk[chunk["at"] < start]
            if len(before):
                inside = before[before["at"] >= start - lead * HOUR]
                best = [tuple(map(int, x)) for x in inside.sort_values(["at", "id"])[["at", "id"]].head(1).itertuples(index=False)]
                if held is not None and held[1] is not None:
                    best.append(tuple(held))
                held = min(best) if best else (None, None)
                timer.update(held)
                timer.setTimeoutTimestamp(start // 1000)

    return runs.groupBy(*names).applyInPandasWithState(fold, schema, _HELD, "append", "EventTimeTimeout")
