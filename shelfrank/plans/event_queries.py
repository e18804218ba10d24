"""Queries on events in batch form: windows, sessions, decay, transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfrank.plans.base import INTER, I, inter, rounded
from shelfrank.sources.catalog import Orders
from shelfrank.streaming import events as ev


def _events(spark, sf):
    return Orders(spark, sf).table("events")


def _decayed(spark, sf):
    df = inter(spark, sf)
    last = df.agg(F.max("timestamp").alias("last"))
    return rounded(ev.decayed_popularity(df.join(F.broadcast(last)), I, "timestamp", "rating", F.col("last")))


QUERIES = {
    "events_tumbling": lambda s, d: rounded(ev.popularity_by_window(_events(s, d))),
    "events_sliding": lambda s, d: rounded(ev.popularity_by_window(_events(s, d), length="2 days", slide="1 day")),
    "events_session": lambda s, d: ev.sessions(_events(s, d)),
    "event_transitions": lambda s, d: rounded(ev.transitions(_events(s, d))),
    "decayed_popularity": _decayed,
}

ORACLES = {
    "events_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "events_sliding": """SELECT (date_trunc('day', ts) - INTERVAL (back) DAY)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total
FROM events CROSS JOIN (VALUES (0), (1)) AS b(back) GROUP BY 1, 2""",
    "events_session": """WITH gaps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events),
numbered AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM numbered GROUP BY user_id, s""",
    "event_transitions": """WITH p AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_item FROM events)
SELECT event_type, next_item, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY event_type) AS DOUBLE), 6) AS share FROM p WHERE next_item IS NOT NULL GROUP BY 1, 2""",
    "decayed_popularity": f"""WITH {INTER} SELECT product_key, round(sum(rating * pow(0.5, (epoch_us((SELECT max(timestamp) FROM inter)) - epoch_us(timestamp)) / 86400e6 / 30)), 6) AS score FROM inter GROUP BY 1""",
}
