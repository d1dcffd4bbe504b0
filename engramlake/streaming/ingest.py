"""Ingest as a stream: idempotent by event id, and a running state for each user."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engramlake.operators import ids, reconcile
from engramlake.session import stored
from engramlake.sources.parts import Keyed

STATE = "n bigint, last_event bigint, last_type string, total double"
OUT = "user_id bigint, late bigint, " + STATE


def read_events(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as a stream with a ``ts`` that a watermark accepts."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def once_each(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Drops events whose id was seen within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, width: str, late: str = "1 day") -> DataFrame:
    """Counts by window and type; a window is put out once no more rows can come for it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """Runs of a user's events with no gap that long between them."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def totals(events: DataFrame) -> DataFrame:
    """The state of each user over events that come once each: built-in aggregates, combined before the shuffle."""
    last = F.max_by("event_type", "event_id").alias("last_type")
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"), last, F.sum("value").alias("total"))


def running(events: DataFrame) -> DataFrame:
    """The state of each user after each batch where order counts: events taken in, the last one by id, the sum of values, and
    how many events of the batch came late.

    An event with an id not beyond the last one taken in is a repeat or comes late; it changes nothing, and is counted in ``late``.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, kind, total = state.get if state.exists else (0, -1, None, 0.0)
        newest, late = last, 0
        for f in frames:  # a frame at a time: only sums are held
            rows = f.drop_duplicates("event_id")
            fresh = rows[rows["event_id"] > last]
            late += len(f) - len(fresh)
            if len(fresh):
                n, total = n + len(fresh), total + float(fresh["value"].sum())
                top = fresh.loc[fresh["event_id"].idxmax()]
                if int(top["event_id"]) > newest:
                    newest, kind = int(top["event_id"]), top["event_type"]
        state.update((n, newest, kind, total))
        yield pd.DataFrame([(key[0], late, n, newest, kind, total)], columns=["user_id", "late", "n", "last_event", "last_type", "total"])

    return events.groupBy("user_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def reconciled(stated: DataFrame) -> DataFrame:
    """The rules of ``operators.reconcile`` as a stream: what becomes of each statement, by user, subject and predicate.

    ``stated``: user_id, id, position, created_at, claim, source_priority, confidence and importance of statements with a
    claim, as a stream. The active statements of a user's keys are one state between batches, as most keys have so few
    rows that a call for each would cost more than the work. Rows of a batch are taken in by
    position and id, and a row that is not beyond the last one taken in of its key comes late: it changes nothing
    and comes out with the status ``late``. Puts out what changes, and what is active after each batch, with ``turn``, the
    number of rows that the key has taken in, so that the newest row of an id (``newest``) is its state. However the
    statements are split into batches, these are the states of the batch run.
    """
    of = ids.kind(stated)
    names = [part.split()[0] for part in reconcile.RECONCILED.format(of).split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = pickle.loads(state.get[0]) if state.exists else {}
        # a user's rows of one batch, which the order of positions needs together; the trigger bounds a batch
        rows = pd.concat(list(frames)).sort_values(["position", "id"])
        out, folds = [], {}
        for r in rows.itertuples(index=False, name="Stated"):
            at = (r.subject, r.predicate)
            if at not in folds:
                folds[at] = reconcile._Statements()
                folds[at].active = known.get(at, ([], None, 0))[0]
            _, last, turn = known.get(at, ([], None, 0))
            if last is not None and (r.position, r.id) <= last:
                out.append((r.user_id, r.id, "late", None, None, None, None, [], -1))
                continue
            known[at] = (folds[at].active, (r.position, r.id), turn + 1)
            out += [(*x, turn + 1) for x in folds[at].row(r)]
        for at, fold in folds.items():
            _, last, turn = known[at]
            out += [(*x, turn) for x in fold.end()]
            known[at] = (fold.active, last, turn)
        state.update((pickle.dumps(known),))
        yield pd.DataFrame(out, columns=[*names, "turn"])

    keyed = stated.withColumns({"subject": F.col("claim.subject"), "predicate": F.col("claim.predicate"), "id": F.col("id").cast(of)})
    keyed = keyed.withColumns({c: F.col(c).cast("double") for c in ("source_priority", "confidence", "importance")})
    return keyed.groupBy("user_id").applyInPandasWithState(step, reconcile.RECONCILED.format(of) + ", turn bigint", "known binary", "update", GroupStateTimeout.NoTimeout)


def with_late(events: DataFrame, updated: DataFrame, key: str, at: str) -> DataFrame:
    """``events`` with ``resolution``: unmatched where what they are about was changed after them (``updated``: key, updated_at), else applied.

    Late events go on; none is dropped.
    """
    known = updated.select(key, "updated_at")
    late = F.coalesce(F.col("updated_at") > F.col(at), F.lit(False))
    return events.join(known, key, "left").withColumn("resolution", F.when(late, "unmatched").otherwise("applied")).drop("updated_at")


def expiring(events: DataFrame, hours: int, grace_hours: int = 0) -> DataFrame:
    """(user_id, last_seen, expired): a user's state goes when the watermark is ``hours`` and the grace beyond their last event; then it is put out once."""
    span = (hours + grace_hours) * 3_600_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(last, unit="us"), True)], columns=["user_id", "last_seen", "expired"])
            return
        last = max([state.get[0] if state.exists else 0, *(int(f["ts"].max().value // 1000) for f in frames)])
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + span, state.getCurrentWatermarkMs() + 1))

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, last_seen timestamp, expired boolean", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def every(spark: SparkSession, seconds: float, job, checkpoint: str, once: bool = False):
    """Runs ``job(n)`` at an interval of processing time, by a stream of ticks whose checkpoint knows what has run; ``once`` runs it now and ends."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda _, n: job(n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(once=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def refreshed(changes: DataFrame, table: Keyed, checkpoint: str):
    """Keeps a table (``sources.parts.Keyed``) up with a stream of changes: key, version, ``deleted`` where it has one, and the rest.

    The last change of each key by its version counts, within a batch and against what is there. A batch that is
    sent again, or that comes late, changes nothing, and only the parts that a batch changes are written.
    """

    def step(batch: DataFrame, n: int) -> None:
        table.merge(stored(batch), n)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there now, into a table in memory (for tests and small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def land(stream: DataFrame, mode: str, at: str) -> DataFrame:
    """Runs a stream over all that is there now into Parquet below ``at``, a shared folder, and reads it.

    Each batch has a folder of its own, which a repeated batch replaces, so a restart adds nothing twice.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/rows/batch={batch}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


def newest(states: DataFrame, key: str, progress: str) -> DataFrame:
    """Of the rows that an updating stream wrote for a key, the one that has come furthest."""
    rest = [c for c in states.columns if c != key]
    return states.groupBy(key).agg(F.max_by(F.struct(*rest), progress).alias("x")).select(key, "x.*")
