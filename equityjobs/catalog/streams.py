"""Queries that run streams over the event table and return their sink."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from equityjobs.catalog.lifecycle import _FIRST_RUN, messages_of_more_chats
from equityjobs.catalog.registry import query
from equityjobs.sources.adapters import Tables
from equityjobs.sources.scratch import scratch_path
from equityjobs.streaming import streams

_EVENTS = "SELECT event_type, user_id % 4 AS chat, event_id % 500 AS message_id, ts FROM events"


class ArrivingTables(Tables):
    """The tables, with one of the base tables as a stream of its files."""

    def __init__(self, spark, folder: str, name: str) -> None:
        super().__init__(spark, folder)
        self.name = name

    def __getattr__(self, name: str):
        found = super().__getattr__(name)
        if name != self.name:
            return found
        return streams.arriving(self.spark, f"{self.folder}/{name}[.]parquet", found.schema)  # a glob: the table may be a file or a folder


def events(t):
    rows = streams.arriving(t.spark, f"{t.folder}/events[.]parquet", t.events.schema)  # a glob: the table may be a file or a folder
    return rows.select("event_type", (F.col("user_id") % 4).alias("chat"), (F.col("event_id") % 500).alias("message_id"), F.col("ts").cast("timestamp").alias("ts"))


@query("m2_stream_first_deliveries", f"SELECT DISTINCT chat, message_id FROM ({_EVENTS}) x")
def _(t):
    firsts = streams.first_deliveries(events(t), ["chat", "message_id"], "ts", "90 days")
    return streams.drained(firsts.select("chat", "message_id"), "append", "deliveries")


@query("m3_stream_daily_counts", f"SELECT CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS bucket, event_type, count(*) AS count FROM ({_EVENTS}) x GROUP BY 1, 2")
def _(t):
    return streams.drained(streams.counts_by_bucket(events(t), "ts", "D", ["event_type"], "2 days"), "complete", "daily")


@query("m3_stream_weekly_counts", f"SELECT CAST(CAST(date_trunc('week', ts + INTERVAL 9 HOUR) AS DATE) AS VARCHAR) AS bucket, event_type, count(*) AS count FROM ({_EVENTS}) x GROUP BY 1, 2")
def _(t):
    return streams.drained(streams.counts_by_bucket(events(t), "ts", "W", ["event_type"], "2 days"), "complete", "weekly")


@query("m1_stream_increments", f"WITH {_FIRST_RUN} SELECT * FROM fetched")
def _(t):
    """The batch job's rows, out of a stream of messages whose marks and failures are state."""
    arriving = ArrivingTables(t.spark, t.folder, "conversations")
    found = streams.increments(messages_of_more_chats(arriving), t.reports, t.attempts, datetime(2024, 1, 3))
    return streams.drained(found, "append", "increments").select("chat", "message_id", "turn")


@query("m2_stream_merge", "SELECT chat, message_id, arg_max(error, event_id) AS error, max(event_id) AS event_id FROM attempts GROUP BY 1, 2")
def _(t):
    """Failures arrive in several runs and are delivered again in a second stream; the table has each message once."""
    path = scratch_path(t.spark, "merged_attempts")
    rows = ArrivingTables(t.spark, t.folder, "events").attempts.select("chat", "message_id", "error", "event_id")
    streams.merged(rows, path, ["chat", "message_id"], "event_id")
    return streams.merged(rows.filter("event_id % 2 = 0"), path, ["chat", "message_id"], "event_id", "again")


_LAST_SIGNS = """
    signs AS (SELECT user_id AS build, ts, event_type = 'view' AS busy FROM events),
    newest AS (SELECT build, max(ts) AS seen, bool_and(busy) FILTER (WHERE ts = last) AS busy FROM (SELECT *, max(ts) OVER (PARTITION BY build) AS last FROM signs) x GROUP BY build)"""


@query("m4_stream_silent_work", f"WITH {_LAST_SIGNS} SELECT build, CAST(seen AS VARCHAR) AS last_seen FROM newest WHERE busy AND seen < (SELECT max(ts) FROM events) - INTERVAL 6 HOUR")
def _(t):
    """Work by user: a view keeps it busy, any other event ends it; silent for six hours before the newest event of all."""
    rows = ArrivingTables(t.spark, t.folder, "events").events
    signs = rows.select(F.col("user_id").alias("build"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return streams.drained(streams.silent(signs, ["build"], "ts", "event_type", "view", 6), "append", "silent")
