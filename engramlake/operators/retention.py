"""Retention: which expired records may go, given holds, tiers and references; what a cleanup changes, and when it is due."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.operators.graph import reachable
from engramlake.session import stored
from engramlake.sources.log import CLOSED, latest

#: Importance from which an expired record is archived, and categories that always are.
ARCHIVE_FROM, ARCHIVED = 0.65, ("semantic", "preference", "procedural")
POLICIES = ("balanced", "expiry")


def plan(records: DataFrame, references: DataFrame, cutoff: Column) -> DataFrame:
    """(id, action): remove, archive, hold or keep.

    ``records``: id, expires_at, held, durable, open_task. Expired up to ``cutoff`` and not held,
    archived or open, a record is eligible; it stays all the same if one that stays refers to it, by
    any chain of ``references`` (src, dst).
    """
    expired = F.coalesce(F.col("expires_at") <= cutoff, F.lit(False))
    first = F.when(~expired | F.col("open_task"), "keep").when(F.col("held"), "hold").when(F.col("durable"), "archive").otherwise("eligible")
    marked = records.select("id", first.alias("first"))
    roots = marked.filter("first <> 'eligible'").select("id")
    kept = reachable(references, roots).withColumn("reached", F.lit(True))
    return marked.join(kept, "id", "left").select("id", F.when(F.col("first") != "eligible", F.col("first")).when(F.col("reached"), "keep").otherwise("remove").alias("action"))


def references(revisions: DataFrame) -> DataFrame:
    """(src, dst): the ids that any revision of a record names, in whatever of these columns there are; never itself."""
    none = F.array().cast("array<string>")
    lists = [F.coalesce(F.col(c).cast("array<string>"), none) for c in ("evidence_ids", "conflict_ids", "candidate_task_ids") if c in revisions.columns]
    single = [F.col(c).cast("string") for c in ("related_task_id", "superseded_by", "consolidated_into", "task_id", "winner_id", "observation_id", "resolved_by") if c in revisions.columns]
    if "task_occurrences" in revisions.columns:
        lists.append(F.coalesce(F.transform("task_occurrences", lambda o: o["event_id"].cast("string")), none))
    every = F.array_distinct(F.array_compact(F.concat(*lists, F.array(*single) if single else none)))
    pairs = revisions.select(F.col("id").cast("string").alias("src"), F.explode(every).alias("dst"))
    return pairs.filter("src <> dst").distinct()


def user_plan(revisions: DataFrame, user: str, now: Column, grace_days: float = 7, policy: str = "balanced") -> DataFrame:
    """(id, action) for the records of one user, by all revisions of all users.

    A record is held if any of its revisions has legal_hold or retain. Under ``balanced``, what is important,
    durable or was redacted is archived; under ``expiry`` nothing is.
    """
    if policy not in POLICIES or not 0 <= grace_days < 36525:
        raise ValueError("a policy of balanced or expiry, and a grace period that can be")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in revisions.columns else F.lit(False)
    held = revisions.groupBy("id").agg(F.bool_or(flag("legal_hold") | flag("retain")).alias("held"))
    last = latest(revisions, "id", "position").join(held, "id")
    durable = F.lit(policy == "balanced") & ((F.col("importance") >= ARCHIVE_FROM) | F.col("category").isin(*ARCHIVED) | flag("redacted"))
    open_task = (F.col("category") == "task") & (F.col("task_status").isNull() | ~F.col("task_status").isin(*CLOSED))
    records = last.select(
        F.col("id").cast("string").alias("id"), F.when(F.col("user_id") == user, F.col("expires_at")).alias("expires_at"), "held", F.coalesce(durable, F.lit(False)).alias("durable"), open_task.alias("open_task"), "user_id"
    )
    cutoff = now - F.make_dt_interval(secs=F.lit(grace_days * 86400).cast("decimal(18,6)"))
    known = records.select(F.col("id").alias("dst"))
    actions = plan(records, references(revisions).join(known, "dst", "left_semi").select("src", "dst"), cutoff)
    return actions.join(records.filter(F.col("user_id") == user).select("id"), "id")


def compacted(revisions: DataFrame, user: str, removed: DataFrame) -> DataFrame:
    """The log without the removed ids (id) and without revisions of the user that say just what the one before of their id said."""
    rest = [c for c in revisions.columns if c not in ("position", "id")]
    left = revisions.join(removed.select(F.col("id").cast(revisions.schema["id"].dataType).alias("id")), "id", "left_anti")
    now = F.xxhash64(*[F.col(c) if not str(revisions.schema[c].dataType).startswith("Map") else F.map_entries(c) for c in rest])
    before = F.lag("_h").over(Window.partitionBy("id").orderBy("position"))
    marked = left.withColumn("_h", now).withColumn("_same", F.coalesce(before == F.col("_h"), F.lit(False)) & (F.col("user_id") == user))
    return marked.filter("not _same").select(*revisions.columns)


def report(revisions: DataFrame, user: str, actions: DataFrame, left: DataFrame) -> DataFrame:
    """One row about a planned cleanup: what is removed and archived, revisions and their size as JSON before and after."""
    size = lambda df, n: df.agg(F.count("*").alias(f"revisions_{n}"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))) + 1), F.lit(0)).alias(f"bytes_{n}"))
    done = actions.agg(F.count_if(F.col("action") == "remove").alias("removed"), F.count_if(F.col("action") == "archive").alias("archived"), F.count_if(F.col("action") == "hold").alias("held"))
    return done.crossJoin(F.broadcast(size(revisions, "before"))).crossJoin(F.broadcast(size(left, "after")))  # one row each


def schedule_key(user: str, grace_days: float, interval_hours: float, policy: str) -> str:
    """A schedule's name; another policy is another schedule."""
    return hashlib.sha256(f"{user}\u0001{grace_days}\u0001{interval_hours}\u0001{policy}".encode()).hexdigest()


def cleanup(revisions: DataFrame, user: str, now: Column, grace_days: float = 7, policy: str = "balanced", apply: bool = False, last_run: DataFrame | None = None, interval_hours: float | None = None, derived: dict[str, DataFrame] | None = None) -> dict:
    """status (not_due, preview or completed), and what was planned: actions, report, the log that is left, and the derived tables without the user.

    ``last_run``: key, completed_at of schedules that ran. Nothing is written here: the caller replaces the derived
    tables first and the log last, so that a failure between leaves a log from which they can be made again.
    """
    if interval_hours is not None:
        if interval_hours <= 0:
            raise ValueError("an interval of more than 0 hours")
        if last_run is not None:
            key = schedule_key(user, grace_days, interval_hours, policy)
            soon = last_run.filter((F.col("key") == key) & (now < F.col("completed_at") + F.make_dt_interval(secs=F.lit(interval_hours * 3600).cast("decimal(18,6)"))))
            if not soon.isEmpty():
                return {"status": "not_due"}
    actions = stored(user_plan(revisions, user, now, grace_days, policy))
    left = compacted(revisions, user, actions.filter("action = 'remove'"))
    out = {"status": "completed" if apply else "preview", "actions": actions, "report": report(revisions, user, actions, left)}
    if apply:
        gone = actions.filter("action = 'remove'").isEmpty()
        out |= {"log": left, "derived": {n: df if gone else purged(df, user) for n, df in (derived or {}).items()}}
    return out


def purged(table: DataFrame, user: str) -> DataFrame:
    """A derived table without a user's rows; every derived table has their user_id."""
    return table.filter(F.col("user_id") != user)
