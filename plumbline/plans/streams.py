"""Queries on progress, windows and turns; the batch forms of the streaming operators, which share their expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.joins import first_wins, remaining
from ..streaming import progress as T
from .frames import frame, table
from .registry import query


@query("progress_rate", "SELECT event_type, count(*)::BIGINT AS n, round(count(*) / (epoch(max(ts) - min(ts)) / 60), 6) AS per_minute, round((5000 - count(*)) / (count(*) / (epoch(max(ts) - min(ts)) / 60)), 3) AS minutes_left FROM events GROUP BY event_type")
def rate(spark, d):
    r = T.rate(table(spark, d, "events"), ["event_type"], "ts", 5000)
    return r.select("event_type", "n", F.round("per_minute", 6).alias("per_minute"), F.round("minutes_left", 3).alias("minutes_left"))


@query("tumbling_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def tumbling(spark, d):
    return T.windowed_counts(table(spark, d, "events"), "ts", "1 day", "1 hour", ["event_type"]).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("sliding_counts", "SELECT event_type, count(*)::BIGINT AS windows, sum(n)::BIGINT AS rows FROM (SELECT event_type, k, count(*) AS n FROM (SELECT event_type, unnest([floor(epoch(ts) / 43200)::BIGINT, floor(epoch(ts) / 43200)::BIGINT - 1]) AS k FROM events) x GROUP BY ALL) y GROUP BY event_type")
def sliding(spark, d):
    w = T.windowed_counts(table(spark, d, "events"), "ts", "1 day", "1 hour", ["event_type"], "12 hours")
    return w.groupBy("event_type").agg(F.count("*").alias("windows"), F.sum("n").alias("rows"))


@query("stalls", "WITH g AS (SELECT user_id, ts, sum((gap)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 12 HOURS, true) AS gap FROM events) x) SELECT user_id, count(DISTINCT s)::BIGINT AS sessions, count(*)::BIGINT AS n FROM g GROUP BY user_id")
def stalls(spark, d):
    s = T.sessions(table(spark, d, "events"), "ts", "12 hours", "1 hour", ["user_id"])
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("first_seen", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_seen(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return first_wins(e, ["user_id", "event_type"], [F.col("event_id")])


@query("resume_remaining", "SELECT task_id FROM {trials} t WHERE task_id % 4 > 0")
def resume(spark, d):
    t = frame(spark, d, "trials").select("task_id")
    return remaining(t, t.where("task_id % 4 = 0"), ["task_id"])


@query("conversation_phases", "SELECT conv_id, turn, CASE WHEN s <= 1 THEN 'a' WHEN s = 2 THEN 'b' WHEN s = 3 THEN 'c' ELSE 'padding' END AS phase FROM (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) x")
def phases(spark, d):
    return T.turns(table(spark, d, "conversations")).select("conv_id", "turn", "phase")
