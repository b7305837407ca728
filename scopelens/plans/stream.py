"""Windowed aggregation of ``events``, as the streams of ``streaming.events`` define it, over the stored table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import events as ev
from .registry import Tables, query


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling_counts(t: Tables) -> DataFrame:
    return ev.tumbling_counts(t.events).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_sessions(t: Tables) -> DataFrame:
    return ev.sessions(t.events)


ARRIVED = """a AS (SELECT *, least(greatest(date_diff('day', TIMESTAMP '2024-01-01', ts), 0) // 10, 2) AS due FROM events),
r AS (SELECT event_id, ts, event_type, value, least(due + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END, 2) AS part FROM a UNION ALL SELECT event_id, ts, event_type, value, due + 1 FROM a WHERE event_id % 7 = 0 AND due < 2),
m AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS mark FROM r GROUP BY part),
w AS (SELECT r.*, mark, time_bucket(INTERVAL 6 HOUR, ts) AS start FROM r JOIN m USING (part))"""


def arrivals(t: Tables) -> list[DataFrame]:
    """``events`` as they arrive in three parts of ten days: a tenth comes one part late, a seventh comes again."""
    a = t.events.withColumn("due", F.expr("least(greatest(datediff(ts, DATE '2024-01-01'), 0) div 10, 2)"))
    late = F.least(F.col("due") + (F.col("event_id") % 10 == 3).cast("int"), F.lit(2))
    every = a.withColumn("part", late).unionByName(a.where("event_id % 7 = 0 AND due < 2").withColumn("part", F.col("due") + 1))
    return [every.where(F.col("part") == k).drop("due", "part") for k in range(3)]


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/streams/{uuid.uuid4().hex}"


@query(f"WITH {ARRIVED} SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE (mark IS NULL OR start + INTERVAL 6 HOUR > mark) AND start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM r) GROUP BY ALL")
def stream_late_windows(t: Tables) -> DataFrame:
    """A live stream in three runs: rows whose window had closed before they came are dropped, open windows aren't given."""
    given = ev.fed(arrivals(t), ev.tumbling_counts, _folder(t))
    return given.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH {ARRIVED} SELECT DISTINCT event_id, ts FROM w WHERE mark IS NULL OR ts > mark")
def stream_unique_events(t: Tables) -> DataFrame:
    """A live stream in three runs: an event that comes again is dropped, and so is one that comes after its watermark."""
    return ev.fed(arrivals(t), ev.unique_events, _folder(t)).select("event_id", "ts")
