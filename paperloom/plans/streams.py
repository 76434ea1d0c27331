"""Queries of change feeds over events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import scans
from ..operators.joins import detect_changes, last_of_each
from ..state import deleted_at_exit, shared_dir
from ..streaming import keyed as K
from ._registry import query


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS last_event FROM events GROUP BY user_id")
def keyed_state(t):
    rows = t("events").select("user_id", "event_type", "event_id", F.col("event_id").alias("last_event"))
    return last_of_each(rows, "user_id", F.col("event_id")).select("user_id", "event_type", "last_event")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def streaming_state(t):
    """The same state, kept in the state store by a stream over the events' files that is run to its end."""
    checkpoint = deleted_at_exit(t.spark, f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}")
    stream = t.spark.readStream.schema(t("events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.sf_dir}/events.parquet*")
    K.watch(stream, "user_id", "event_type", "event_id", checkpoint).awaitTermination()
    return K.state(t.spark, checkpoint).select(F.col("key").cast("long").alias("user_id"), F.col("mark").alias("event_type"), F.col("last_seen").alias("event_id"))


@query(
    """WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS m FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, event_id) AS m FROM events WHERE event_id % 3 = 0 GROUP BY 1)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'new' WHEN b.user_id IS NULL THEN 'deleted' WHEN a.m <> b.m THEN 'modified' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id"""
)
def snapshot_changes(t):
    e = t("events").select("user_id", F.col("event_type").alias("m"), "event_id")
    return detect_changes(last_of_each(e.where("event_id % 2 = 0"), "user_id", F.col("event_id")), last_of_each(e.where("event_id % 3 = 0"), "user_id", F.col("event_id")), "user_id", "m")


@query(
    """SELECT user_id, CAST(run AS BIGINT) AS run, event_type, arg_min(value, event_id) AS value, arg_max(event_id, event_id) AS last_event, count(*) AS edits FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM
    (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, run, event_type"""
)
def edit_coalesce(t):
    e = t("events").select("user_id", "event_id", "event_type", "value", F.col("event_id").alias("last_event"))
    return scans.coalesced(e, "user_id", ["event_id"], ["event_type"], "value", "last_event")


@query(
    """WITH e AS (SELECT user_id, event_id, event_type, event_type = 'error' AS undo FROM events),
    r AS (SELECT *, sum(CASE WHEN undo THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS raw FROM e),
    d AS (SELECT *, raw - least(0, min(raw) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS depth FROM r),
    l AS (SELECT *, min(depth) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM d)
    SELECT user_id, event_id, event_type FROM l WHERE NOT undo AND coalesce(later, depth) >= depth"""
)
def edits_after_undo(t):
    e = t("events").select("user_id", "event_id", "event_type", (F.col("event_type") == "error").alias("undo"))
    return scans.undone(e, "user_id", ["event_id"], "undo").select("user_id", "event_id", "event_type")


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_props(t):
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
