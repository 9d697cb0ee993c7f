"""Streaming queries over tables read as file streams; each is run over all that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veyra.plans.registry import query
from veyra.sources.tables import Tables
from veyra.streaming.drain import drain, open_files
from veyra.streaming.state import changes, daily_counts, once, trailing_rollup


def _stream(t: Tables, name: str) -> DataFrame:
    return open_files(t._spark, f"{t._folder}/{name}.parquet")


def _events(t: Tables) -> DataFrame:
    return _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(t: Tables) -> DataFrame:
    return drain(daily_counts(_events(t), "ts", "event_type"), "update", ["day", "event_type"])


@query("""WITH d AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT day) AS days FROM d WHERE day > (SELECT max(day) FROM d) - INTERVAL 7 DAY GROUP BY 1 HAVING count(DISTINCT day) >= 3""")
def stream_trailing_week(t: Tables) -> DataFrame:
    return trailing_rollup(stream_daily_counts(t), "event_type", 7, 3, 90)


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e) SELECT user_id, min(ts) AS starts, count(*) AS events FROM s GROUP BY user_id, session""")
def stream_sessions(t: Tables) -> DataFrame:
    s = _events(t).withWatermark("ts", "2 days").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("events"))
    return drain(s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("starts"), "events"), "complete")


@query("""WITH r AS (SELECT DISTINCT response_id, dz_id, name_full, fetched_at FROM dz_responses), h AS (SELECT *, lag(name_full) OVER w AS before FROM r WINDOW w AS (PARTITION BY dz_id ORDER BY fetched_at, response_id))
SELECT dz_id, count(*) AS fetches, count(*) FILTER (WHERE before IS NOT NULL AND before IS DISTINCT FROM name_full) AS changes FROM h GROUP BY 1""")
def stream_changes(t: Tables) -> DataFrame:
    r = _stream(t, "dz_responses").select("response_id", "dz_id", "name_full", "fetched_at")
    return drain(changes(r, "dz_id", ["fetched_at", "response_id"], "name_full"), "update", ["dz_id"])


@query("SELECT DISTINCT price_id FROM pricing")
def stream_once(t: Tables) -> DataFrame:
    """Repeated deliveries of one row count once."""
    p = _stream(t, "pricing").select("price_id", F.col("loaded_at").cast("timestamp").alias("at"))
    return drain(once(p, ["price_id"], "at", "400 days").select("price_id"))
