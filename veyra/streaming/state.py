"""Stateful stream operators: counters with retention, change detection, liveness, attribution once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_counts(stream: DataFrame, time: str, key: str, late: str = "2 days") -> DataFrame:
    """(day, key, n): counts by day; events later than ``late`` are left out once their day's state is gone."""
    day = stream.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), key).agg(F.count("*").alias("n"))
    return day.select(F.col("w.start").cast("timestamp_ntz").alias("day"), key, "n")


def trailing_rollup(days: DataFrame, key: str, window: int, least_days: int, retention: int) -> DataFrame:
    """(key, n, days) over the last ``window`` of the days kept, keys seen on fewer than ``least_days`` left out."""
    newest = days.agg(F.max("day").alias("newest")).scalar()
    d = days.filter(F.col("day") > newest - F.make_dt_interval(F.lit(min(window, retention))))
    return d.groupBy(key).agg(F.sum("n").alias("n"), F.count_distinct("day").alias("days")).filter(F.col("days") >= least_days)


def changes(stream: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, fetches, changes) so far: how often a polled record came, and how often with another value.

    The state of a key is its last value and both counts, whatever the number of polls.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(order)
        last, fetches, changed, seen = state.get if state.exists else (None, 0, 0, False)
        for v in pdf[value]:
            v = None if v is None or v != v else v
            if seen and last is not None and v != last:
                changed += 1
            last, seen, fetches = v, True, fetches + 1
        state.update((last, fetches, changed, seen))
        yield pd.DataFrame({key: [k[0]], "fetches": [fetches], "changes": [changed]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, fetches long, changes long", "last string, fetches long, changed long, seen boolean", "update", GroupStateTimeout.NoTimeout)


def liveness(stream: DataFrame, key: str, time: str, quiet: str = "1 day") -> DataFrame:
    """(key, status, last_at): ``alive`` while ticks come, ``stale`` once the watermark is ``quiet`` past the last one.

    A key's state is its last tick; it is dropped when the key goes stale, and a later tick opens it again.
    """
    millis = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "status": ["stale"], "last_at": [pd.Timestamp(last, unit="us")]})
            return
        last = max(int(pd.Timestamp(p[time].max()).value // 1000) for p in batches)
        last = max(last, state.get[0]) if state.exists else last
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + millis, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "status": ["alive"], "last_at": [pd.Timestamp(last, unit="us")]})

    kind = dict(stream.dtypes)[key]
    return stream.withWatermark(time, "1 hour").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, status string, last_at timestamp", "last long", "update", GroupStateTimeout.EventTimeTimeout)


def once(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each key once, however often its evidence arrives within ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def capped_counts(stream: DataFrame, time: str, key: str, order: str, cap: int) -> DataFrame:
    """(day, key, n) so far: counts by day of the first ``cap`` keys of a day; later new keys of that day are not counted.

    A day's state is its keys with their counts, at most ``cap``.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, counts = (list(x) for x in state.get) if state.exists else ([], [])
        at = {v: i for i, v in enumerate(keys)}
        for v in pd.concat(list(batches)).sort_values([time, order])[key]:
            if v in at:
                counts[at[v]] += 1
            elif len(keys) < cap:
                at[v] = len(keys)
                keys.append(int(v))
                counts.append(1)
        state.update((keys, counts))
        yield pd.DataFrame({"day": [k[0]] * len(keys), key: keys, "n": counts})

    days = stream.filter(f"{key} is not null").withColumn("day", F.to_date(time)).select("day", time, key, order)
    return days.groupBy("day").applyInPandasWithState(step, f"day date, {key} long, n long", "keys array<long>, counts array<long>", "update", GroupStateTimeout.NoTimeout)


def transitions(stream: DataFrame, key: str, kind: str, order: list[str]) -> DataFrame:
    """(key, uncertain, settled) so far: how often an error, or a purchase, followed right after a click.

    A key's state is its last kind of event and both counts.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, uncertain, settled = state.get if state.exists else ("", 0, 0)
        for v in pd.concat(list(batches)).sort_values(order)[kind]:
            uncertain += v == "error" and last == "click"
            settled += v == "purchase" and last == "click"
            last = v
        state.update((last, int(uncertain), int(settled)))
        yield pd.DataFrame({key: [k[0]], "uncertain": [int(uncertain)], "settled": [int(settled)]})

    of = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {of}, uncertain long, settled long", "last string, uncertain long, settled long", "update", GroupStateTimeout.NoTimeout)


def attributed(stream: DataFrame, key: str, order: list[str], evidence: str) -> DataFrame:
    """(key, deliveries, conflicts) so far: the first evidence of a key holds, other evidence is a conflict, the same again is none.

    A delivery is a distinct row of a batch; a key's state is its first evidence and both counts.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, deliveries, conflicts, seen = state.get if state.exists else (None, 0, 0, False)
        for v in pd.concat(list(batches)).drop_duplicates().sort_values(order)[evidence]:
            v = None if v is None or v != v else v
            if not seen:
                first, seen = v, True
            deliveries, conflicts = deliveries + 1, conflicts + (v != first)
        state.update((first, deliveries, int(conflicts), seen))
        yield pd.DataFrame({key: [k[0]], "deliveries": [deliveries], "conflicts": [int(conflicts)]})

    of = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {of}, deliveries long, conflicts long", "first string, deliveries long, conflicts long, seen boolean", "update", GroupStateTimeout.NoTimeout)
