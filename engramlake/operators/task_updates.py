"""Which task a message is about, and what it does to that task or to one occurrence of its series."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.functions import rules, schedule
from engramlake.functions import tasks as T
from engramlake.operators import ids
from engramlake.operators.folds import Step, fold


def matched(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """(event_id, resolution, task_id, candidates): applied with the one task, ambiguous with several, or unmatched.

    ``events``: event_id, user_id, session_id, at, reference; ``tasks``: task_id, user_id, session_id,
    updated_at, content. A task changed after the event is none of its candidates. Each way of meeting is an
    equi-join, so that the events and tasks of a user with very many of both do not all meet.
    """
    e = events.select("event_id", "user_id", F.col("session_id").alias("in_session"), "at", T.key(F.col("reference")).alias("wanted"))
    e = e.withColumn("bare", F.size(F.array_except("wanted", F.array(*map(F.lit, T.PRONOUNS)))) == 0)
    t = tasks.select("task_id", "user_id", "session_id", "updated_at", T.key(F.col("content")).alias("key"))
    named = e.filter(~F.col("bare"))
    by_session = e.filter("bare").withColumnRenamed("in_session", "session_id").join(t, ["user_id", "session_id"])
    by_key = named.join(t.withColumn("wanted", F.col("key")), ["user_id", "wanted"])
    by_word = named.withColumn("word", F.col("wanted")[0]).join(t.withColumn("word", F.explode("key")), ["user_id", "word"])
    by_word = by_word.filter((F.col("key") != F.col("wanted")) & (T.refers(F.col("key"), F.col("wanted")) == 1))
    found = None
    for tier, way in ((3, by_session), (2, by_key), (1, by_word)):
        rows = way.filter("updated_at <= at").select("event_id", "task_id", F.lit(tier).alias("tier"))
        found = rows if found is None else found.unionByName(rows)
    each = found.groupBy("event_id", "tier").agg(F.array_sort(F.collect_set("task_id")).alias("candidates"))
    best = each.groupBy("event_id").agg(F.max_by("candidates", "tier").alias("candidates"))
    n = F.size("candidates")
    out = events.select("event_id").join(best, "event_id", "left")
    resolution = F.when(n == 1, "applied").when(n > 1, "ambiguous").otherwise("unmatched")
    return out.select("event_id", resolution.alias("resolution"), F.when(n == 1, F.col("candidates")[0]).alias("task_id"), "candidates")


#: What ``revised`` gives, by the type of ids.
REVISED = (
    "user_id string, id {0}, resolution string, task_id {0}, candidates array<{0}>, task_status string, due_at timestamp_ntz, next_due_at timestamp_ntz, "
    "anchor timestamp_ntz, index int, n_occurrences int, previous_due timestamp_ntz, scheduled_at timestamp_ntz"
)
_SPAN = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def occurrence_at(rule: dict, index: int) -> pd.Timestamp:
    """The occurrence of a rule (unit, interval, anchor) so many steps after its anchor; months end on their last day."""
    n = rule["interval"] * index
    if rule["unit"] in ("day", "week"):
        return rule["anchor"] + pd.Timedelta(days=n * (7 if rule["unit"] == "week" else 1))
    return rule["anchor"] + pd.DateOffset(months=n * (12 if rule["unit"] == "year" else 1))


class _Tasks(Step):
    """A user's open tasks. An event that names one of them ends it, moves it, or settles one occurrence of its series."""

    def __init__(self):
        self.open: dict[int | str, dict] = {}

    def row(self, r) -> list[tuple]:
        if r.is_task:
            self.open[r.id] = {
                "id": r.id, "key": list(r.key), "session": r.session_id, "updated": r.created_at, "due": _time(r.due), "next": _time(r.next_due_at), "rule": None if r.unit is None else {"unit": r.unit, "interval": int(r.every), "anchor": r.anchor},
                "series": r.recurs, "index": 0, "settled": [],
            }
            return []
        candidates = [t for t in self.open.values() if t["updated"] <= r.created_at]
        candidates = [t for t in candidates if t["id"] == r.task_id] if pd.notna(r.task_id) else self._named(candidates, list(r.wanted), r.session_id)
        if len(candidates) != 1:
            return [self._out(r, "ambiguous" if candidates else "unmatched", None, [t["id"] for t in candidates])]
        t = candidates[0]
        refused, told = self._revise(t, r)
        if refused:
            return [self._out(r, refused, None, [t["id"]])]
        t["updated"] = r.created_at
        if t.get("status"):
            del self.open[t["id"]]
        return [self._out(r, "applied", t, [t["id"]], *told)]

    @staticmethod
    def _named(tasks: list[dict], wanted: list[str], session: str) -> list[dict]:
        if not set(wanted) - set(T.PRONOUNS):
            return [t for t in tasks if t["session"] == session]
        exact = [t for t in tasks if t["key"] == wanted]
        numbers = lambda k: {w for w in k if w.isdigit()}
        return exact or [t for t in tasks if set(wanted) <= set(t["key"]) and numbers(t["key"]) == numbers(wanted)]

    def _revise(self, t: dict, r) -> tuple[str | None, tuple]:
        """Why the task stays as it is, or else (None, (due before, scheduled)); changes the task."""
        one = t["series"] and r.scope != "series"
        if one:
            if not t["rule"]:
                return "unsupported_schedule", ()
            scheduled = occurrence_at(t["rule"], t["index"])
            at = pd.notna(r.occurrence_at) or r.selected is not None
            if at and not self._is(r, t["next"], scheduled):
                before = any(self._is(r, due, planned) for planned, due in t["settled"])
                return "already_resolved" if before else "occurrence_not_current", ()
            if not at and r.kind == "completed" and t["next"].date() != r.created_at.date():
                return "occurrence_required", ()
        before = t["next"] if t["series"] else t["due"]
        if r.kind == "rescheduled":
            new = _time(r.due_at) if pd.notna(r.due_at) else (before + pd.Timedelta(seconds=r.delay) if before is not None else None) if pd.notna(r.delay) else _time(r.new_due)
            if new is None:
                return "missing_deadline", ()
            if t["series"] and not t["rule"]:
                return "unsupported_schedule", ()
            if t["series"] and not one:
                if any(new <= max(pair) for pair in t["settled"]):
                    return "series_overlaps_history", ()
                t["rule"], t["index"] = {**t["rule"], "anchor": new}, 0
            elif t["series"] and new >= occurrence_at(t["rule"], t["index"] + 1):
                return "occurrence_overlaps_next", ()
            t["next" if t["series"] else "due"] = new
        elif one:
            t["settled"].append((scheduled, t["next"]))
            t["index"] += 1
            t["next"] = occurrence_at(t["rule"], t["index"])
        else:
            t["status"], t["next"] = r.kind, None
        return None, (before, scheduled if one else None)

    @staticmethod
    def _is(r, due: pd.Timestamp, scheduled: pd.Timestamp) -> bool:
        if pd.notna(r.occurrence_at):
            return r.occurrence_at in (due, scheduled)
        return r.selected in (due.date(), scheduled.date())

    @staticmethod
    def _out(r, resolution: str, t: dict | None, candidates: list[int], before=None, scheduled=None) -> tuple:
        if t is None:
            return (r.user_id, r.id, resolution, None, candidates, None, None, None, None, None, None, None, None)
        rule = t["rule"] or {}
        return (r.user_id, r.id, resolution, t["id"], candidates, t.get("status") or "active", t["due"], t["next"], rule.get("anchor"), t["index"], len(t["settled"]), before, scheduled)


def _time(x) -> pd.Timestamp | None:
    return None if pd.isna(x) else x


def revised(records: DataFrame, position: str = "created_at") -> DataFrame:
    """What each task event did (REVISED): applied, ambiguous, unmatched, or why its task stays as it is.

    ``records``: those of ``ingest.process``, and, where there, task_id, task_scope and occurrence_at (a time
    without a zone) or occurrence_on (a date). Tasks and events of a user are taken in by ``position`` and id; a
    task that was changed after an event is none of its candidates. Refusals: unsupported_schedule,
    already_resolved, occurrence_not_current, occurrence_required, missing_deadline,
    series_overlaps_history, occurrence_overlaps_next.
    """
    c = F.col
    of = ids.kind(records)
    kinds = {"task_id": of, "task_scope": "string", "occurrence_at": "timestamp_ntz", "occurrence_on": "date"}
    r = records.withColumns({n: (c(n) if n in records.columns else F.lit(None)).cast(t) for n, t in kinds.items()})
    task = (c("category") == "task") & c("task_status").isNotNull()
    r = r.filter(task | (c("action").isNotNull() & (c("role") == "user")))
    delay = r"^delay (\d+)\s+(minute|hour|day|week)s?\b"
    text = c("action.due_text")
    unit = F.create_map(*[F.lit(x) for kv in _SPAN.items() for x in kv])
    day = F.regexp_extract(c("action.reference"), r"\b(today|tomorrow|yesterday)\b", 1)
    ahead = F.when(day == "today", 0).when(day == "tomorrow", 1).when(day == "yesterday", -1)
    named = F.coalesce(c("occurrence_on"), F.regexp_extract(c("action.reference"), r"\b(\d{4}-\d{2}-\d{2})\b", 1).try_cast("date"), F.date_add(F.to_date("created_at"), ahead))
    rows = r.select(
        "user_id", c("id").cast(of).alias("id"), c(position).alias("position"), "session_id", "created_at", task.alias("is_task"), T.key(c("content")).alias("key"), c("due"), "next_due_at", c("due_at"),
        c("recurrence.unit").alias("unit"), c("recurrence.interval").alias("every"), c("recurrence.anchor").alias("anchor"), rules.recurring(c("content")).alias("recurs"), c("action.kind").alias("kind"),
        F.coalesce("task_scope", "action.scope", F.lit("occurrence")).alias("scope"), F.coalesce(T.key(c("action.reference")), F.array().cast("array<string>")).alias("wanted"), "task_id", "occurrence_at", F.when(c("occurrence_at").isNull(), named).alias("selected"),
        (F.nullif(F.regexp_extract(text, delay, 1), F.lit("")).try_cast("bigint") * unit[F.nullif(F.regexp_extract(text, delay, 2), F.lit(""))]).cast("double").alias("delay"), schedule.deadline(text, c("created_at"))["due"].alias("new_due"),
    )
    return fold(rows, ["user_id"], ["position", "id"], _Tasks, REVISED.format(of))


def current(records: DataFrame, revisions: DataFrame) -> DataFrame:
    """(id, task_status, due_at, next_due_at, n_occurrences) of each task after its last applied revision."""
    done = revisions.filter("resolution = 'applied'").groupBy(F.col("task_id").alias("id")).agg(F.max_by(F.struct("task_status", "due_at", "next_due_at", "n_occurrences"), F.struct("n_occurrences", F.col("id"))).alias("x"))
    t = records.filter("category = 'task'").select(F.col("id").cast(ids.kind(records)).alias("id"), F.struct(F.lit("active").alias("task_status"), F.col("due").alias("due_at"), "next_due_at", F.lit(0).alias("n_occurrences")).alias("first"))
    return t.join(done, "id", "left").select("id", F.coalesce("x", "first").alias("x")).select("id", "x.*")
