"""Queries that run a stream over the events until they end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import shared_path
from ..streaming import stateful
from .registry import query

#: Rows that the final watermark, an hour behind the newest event in whole milliseconds, has passed.
MARK = "SELECT epoch_us(max(ts)) // 1000 - 3600000 AS mark FROM events"


@query(
    "stream_latest_requests",
    f"""WITH e AS (SELECT *, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER w AS next_us, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS generation FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id AS client, event_id AS request, CAST(generation AS BIGINT) AS generation FROM e, ({MARK})
        WHERE event_type <> 'signup' AND (next_us IS NULL OR next_us > us + 3600000000) AND (us + 3600000000 + 999) // 1000 <= mark""",
)
def stream_latest_requests(read, spark):
    """Requests of the last hour's quiet, each with its client's generation; what newer ones supersede is dropped."""
    build = lambda events: stateful.latest_requests(events.withColumn("what", F.when(F.col("event_type") == "signup", "advance").otherwise("request")), "user_id", "ts", "event_id", "what", 3_600_000, "1 hour")
    return stateful.until_the_end(spark, read.path("events"), 1, build, shared_path(spark, "latest-requests"))


@query(
    "stream_undo_log",
    f"""WITH RECURSIVE e AS (
          SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'undo' WHEN 'error' THEN 'redo' ELSE 'edit' END AS what, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
          FROM events, ({MARK}) WHERE (epoch_us(ts) + 999) // 1000 <= mark
        ), f AS (
          SELECT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS undo, CAST([] AS BIGINT[]) AS redo FROM (SELECT DISTINCT user_id FROM e)
          UNION ALL
          SELECT f.user_id, e.event_id, e.n,
                 CASE what WHEN 'undo' THEN undo[:greatest(len(undo) - 1, 0)] WHEN 'redo' THEN list_concat(undo, redo[greatest(len(redo), 1):]) ELSE list_concat(undo[greatest(len(undo) - 1, 1):], [e.event_id]) END,
                 CASE what WHEN 'undo' THEN list_concat(redo, undo[greatest(len(undo), 1):]) WHEN 'redo' THEN redo[:greatest(len(redo) - 1, 0)] ELSE [] END
          FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1
        )
        SELECT user_id AS owner, event_id AS action, CAST(len(undo) AS INTEGER) AS undo_count, CAST(len(redo) AS INTEGER) AS redo_count, undo[-1] AS top FROM f WHERE n > 0""",
)
def stream_undo_log(read, spark):
    """Undo and redo stacks of each user, three deep, after each of their actions."""
    what = F.when(F.col("event_type") == "purchase", "undo").when(F.col("event_type") == "error", "redo").otherwise("edit")
    build = lambda events: stateful.undo_log(events.withColumn("what", what), "user_id", "ts", "event_id", "what", "1 hour", depth=3)
    return stateful.until_the_end(spark, read.path("events"), 1, build, shared_path(spark, "undo-log"))
