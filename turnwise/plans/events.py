"""Queries over the event table: batch runs of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.session import table
from turnwise.streaming import sessions as st


def event_sessions(spark, sf):
    return st.gap_sessions(table(spark, sf, "events"), "user_id", "ts", "6 hours", "1 day")


def event_windows(spark, sf):
    return st.window_counts(table(spark, sf, "events").filter("value is not null"), "event_type", "ts", "1 day", None, "1 day").select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "rows", "value")


def event_sliding_windows(spark, sf):
    out = st.window_counts(table(spark, sf, "events").filter("value is not null"), "event_type", "ts", "2 days", "1 day", "1 day")
    return out.select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "rows", "value")


QUERIES = {f.__name__: f for f in (event_sessions, event_windows, event_sliding_windows)}
SQL = {
    "event_sessions": """WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOURS THEN 1 ELSE 0 END AS br FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(br) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM l) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS rows FROM s GROUP BY user_id, n""",
    "event_windows": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, sum(value) AS value FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2",
    "event_sliding_windows": """WITH d AS (SELECT event_type, value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS day FROM events WHERE value IS NOT NULL AND ts IS NOT NULL)
        SELECT event_type, strftime(day, '%Y-%m-%d') AS day, count(*) AS rows, sum(value) AS value FROM d GROUP BY 1, 2""",
}
