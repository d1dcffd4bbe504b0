"""Streams over the events, run to their end into the shared folder; each has the rows of one batch query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.operators import reconcile
from engramlake.plans.registry import query, table
from engramlake.session import shared_folder
from engramlake.streaming import ingest


def _events(spark: SparkSession, d: str) -> DataFrame:
    # a pattern, since a stream takes a folder or a pattern, and the table may be one file
    return ingest.read_events(spark, f"{d}/{{events}}.parquet", table(spark, d, "events").schema)


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT event_id, user_id, event_type, round(value, 4) AS value FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Every event is sent twice and taken in once."""
    sent = _events(spark, d).union(_events(spark, d))
    return ingest.land(ingest.once_each(sent), "append", _folder(spark)).select("event_id", "user_id", "event_type", F.round("value", 4).alias("value"))


@query("SELECT user_id, count(*) AS n, max(event_id) AS last_event, arg_max(event_type, event_id) AS last_type, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    states = ingest.newest(ingest.land(ingest.running(_events(spark, d)), "update", _folder(spark)), "user_id", "n")
    return states.select("user_id", "n", "last_event", "last_type", F.round("total", 2).alias("total"))


@query("SELECT user_id, count(*) AS n, max(event_id) AS last_event, arg_max(event_type, event_id) AS last_type, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_totals(spark: SparkSession, d: str) -> DataFrame:
    """Every event is sent twice, taken in once and summed up by built-in aggregates."""
    sent = ingest.once_each(_events(spark, d).union(_events(spark, d)))
    done = ingest.land(sent, "append", _folder(spark))
    return ingest.totals(done).select("user_id", "n", "last_event", "last_type", F.round("total", 2).alias("total"))


@query("""SELECT event_id, CASE WHEN m.u > e.ts THEN 'unmatched' ELSE 'applied' END AS resolution FROM events e LEFT JOIN (SELECT user_id, min(ts) AS u FROM events WHERE event_type = 'purchase' GROUP BY 1) m USING (user_id)""")
def stream_late(spark: SparkSession, d: str) -> DataFrame:
    """Events before their user's first purchase come out as unmatched, and none is lost."""
    first = table(spark, d, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("updated_at"))
    return ingest.land(ingest.with_late(_events(spark, d), first, "user_id", "ts"), "append", _folder(spark)).select("event_id", "resolution")


def _stated(events: DataFrame) -> DataFrame:
    """Each event as a statement of its user: of seven things, which one it is now."""
    none = F.lit(None).cast("string")
    claim = F.struct(
        F.lit("self").alias("subject"), F.concat(F.lit("p"), (F.col("event_id") % 7).cast("string")).alias("predicate"), F.col("event_type").alias("value"), F.lit(True).alias("positive"), F.lit(True).alias("exclusive"),
        F.lit("semantic").alias("kind"), F.col("event_type").alias("display_value"), F.lit("User").alias("display_subject"), none.alias("alternative"), none.alias("subject_type"), none.alias("object_type"),
    )
    made = F.timestamp_seconds(F.col("event_id")).cast("timestamp_ntz")
    return events.select(
        F.col("user_id").cast("string").alias("user_id"), F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("id"), F.col("event_id").alias("position"), made.alias("created_at"), F.col("event_type").alias("content"),
        F.lit("semantic").alias("category"), F.lit(True).alias("reconcilable"), claim.alias("claim"), F.lit(0.0).alias("source_priority"), F.lit(0.5).alias("confidence"), F.lit(0.5).alias("importance"),
    )


#: Of exclusive statements of one rank the newest stands: equal ones in a row join the first of them, and another one takes its place.
_STANDS = """WITH s AS (SELECT user_id::VARCHAR AS user_id, 'e' || lpad(event_id::VARCHAR, 12, '0') AS id, event_id % 7 AS p, event_type, event_id FROM events),
l AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY user_id, p ORDER BY event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id, p ORDER BY event_id) AS run FROM l),
f AS (SELECT user_id, p, run, min(id) AS first FROM g GROUP BY 1, 2, 3)
SELECT g.user_id, g.id, CASE WHEN g.id <> f.first THEN 'consolidated' WHEN n.first IS NULL THEN 'active' ELSE 'superseded' END AS status,
CASE WHEN g.id = f.first THEN n.first END AS superseded_by, CASE WHEN g.id <> f.first THEN f.first END AS consolidated_into
FROM g JOIN f USING (user_id, p, run) LEFT JOIN f n ON n.user_id = g.user_id AND n.p = g.p AND n.run = g.run + 1"""


@query(_STANDS)
def reconcile_events(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each statement that the events make."""
    return reconcile.reconciled(_stated(table(spark, d, "events")), "position").select("user_id", "id", "status", "superseded_by", "consolidated_into")


@query(_STANDS)
def stream_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream; tests split it into batches."""
    return ingest.newest(ingest.land(ingest.reconciled(_stated(_events(spark, d))), "update", _folder(spark)), "id", "turn").select("user_id", "id", "status", "superseded_by", "consolidated_into")
