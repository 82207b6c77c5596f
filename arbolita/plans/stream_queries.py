"""Streams run to their end, as queries; complete-mode ones have the batch result as their SQL."""

from pyspark.sql import functions as F

from arbolita.registry import query
from arbolita.streaming import events as E


@query("stream_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    out = E.finished(E.tumbling(E.read_events(spark, sf_dir)), "tumbling", "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "stream_sliding",
    """SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY start""",
)
def stream_sliding(spark, sf_dir):
    return E.finished(E.sliding(E.read_events(spark, sf_dir)), "sliding", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sessions")
def stream_sessions(spark, sf_dir):
    return E.finished(E.sessions(E.read_events(spark, sf_dir)), "sessions").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_distinct", "SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_distinct(spark, sf_dir):
    return E.finished(E.without_repeats(E.read_events(spark, sf_dir)).select("event_id", "user_id", "event_type"), "distinct")


@query("stream_attempts")
def stream_attempts(spark, sf_dir):
    return E.finished(E.attempts(E.read_events(spark, sf_dir)), "attempts")
