"""Deadlines and recurring schedules from text, as DataFrame expressions.

All times are wall-clock times of the speaker (``timestamp_ntz``). Wording that is not known gives
null. A date or hour that cannot be gives null too, and the column ``problem`` says why, so that one
bad text among many does not end a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramlake.functions import rules

WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
_DAY = "|".join(WEEKDAYS)
_SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800}
_CADENCES = {"daily": "day", "weekly": "week", "monthly": "month", "yearly": "year", "every morning": "day", "every evening": "day"}
_CLOCK = r"\b(?:at|by)\s+(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\b"
_DATE = r"\b(\d{4}-\d{2}-\d{2})(?:t(\d{2}:\d{2}(?::\d{2})?)(z|[+-]\d{2}:\d{2})?)?\b"


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _midnight(day: Column) -> Column:
    return day.cast("timestamp_ntz")


def _minutes(offset: Column) -> Column:
    """+05:30 in minutes; z is 0, and so is a missing offset."""
    size = F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 5, 2).try_cast("int")
    return F.when(offset.startswith("-"), -size).when(offset.startswith("+"), size).otherwise(0)


def deadline(text: Column, reference: Column, zone_minutes: Column | None = None) -> Column:
    """struct(due, problem): when something is due, said at ``reference`` by someone ``zone_minutes`` ahead of UTC.

    A day without an hour ends at 23:59:59. Negated dates and alternatives are no deadline.
    """
    zone = F.lit(0) if zone_minutes is None else zone_minutes
    return rules.given(F.lower(F.translate(text, "’", "'")), lambda t: rules.given(_named_times(t, F.to_date(reference)), lambda x: _due(x, reference, zone)))


def _named_times(t: Column, today: Column) -> Column:
    """What a text names: seconds from now, a date with its time and offset, a day, and the hour on it."""
    span = r"\bin\s+(\d+)\s+(minute|hour|day|week)s?\b"
    date, time, offset = (_group(t, _DATE, k) for k in (1, 2, 3))
    weekday = F.array_position(F.array(*map(F.lit, WEEKDAYS)), _group(t, rf"\b({_DAY})\b", 1)).cast("int") - 1
    until = F.pmod(weekday - F.weekday(today), F.lit(7))
    until = F.when((until == 0) & (_group(t, rf"\b(?:(next|this)\s+)?({_DAY})\b", 1) == "next"), 7).otherwise(until)
    day = (
        F.when(date.isNotNull(), date.try_cast("date"))
        .when(t.rlike(r"\btomorrow\b"), F.date_add(today, 1)).when(t.rlike(r"\b(?:today|tonight)\b"), today)
        .when(t.rlike(r"\bnext week\b"), F.date_add(today, 7)).when(weekday >= 0, F.date_add(today, until))
    )
    return F.struct(
        F.coalesce(t.rlike(r"\b(?:not|never|no longer)\b|\bor\b"), F.lit(True)).alias("vague"), _group(t, span, 1).alias("ahead"),
        (_group(t, span, 1).try_cast("decimal(18,0)") * _map(_SECONDS)[_group(t, span, 2)]).alias("span"),
        date.alias("date"), time.alias("time"), offset.alias("offset"), F.concat(date, F.lit(" "), time).try_cast("timestamp_ntz").alias("moment"), day.alias("day"),
        _group(t, _CLOCK, 1).cast("int").alias("hour"), F.coalesce(_group(t, _CLOCK, 2).cast("int"), F.lit(0)).alias("minute"), _group(t, _CLOCK, 3).alias("half"),
    )


def _due(x: Column, reference: Column, zone: Column) -> Column:
    room = F.datediff(F.lit("9999-12-31").cast("date"), F.to_date(reference)).cast("bigint") * 86400
    reachable = F.coalesce(x["span"] <= room, F.lit(False))
    later = reference + F.make_dt_interval(secs=F.when(reachable, x["span"]).otherwise(0).cast("decimal(18,6)"))
    moved = x["moment"] + F.make_dt_interval(mins=F.when(x["offset"].isNotNull(), zone - _minutes(x["offset"])).otherwise(0))
    halved = x["half"].isNotNull()
    real = F.when(halved, x["hour"].between(1, 12)).otherwise(x["hour"] < 24) & (x["minute"] < 60)
    hour = F.when(halved, x["hour"] % 12 + F.when(x["half"] == "pm", 12).otherwise(0)).otherwise(x["hour"])
    end = F.make_dt_interval(hours=F.lit(23), mins=F.lit(59), secs=F.lit(59))
    on_day = _midnight(x["day"]) + F.when(hour.isNull(), end).otherwise(F.make_dt_interval(hours=hour, mins=x["minute"]))
    due = F.when(x["vague"], None).when(x["ahead"].isNotNull(), F.when(reachable, later)).when(x["time"].isNotNull(), moved).when(hour.isNull() | real, on_day)
    problem = (
        F.when(x["vague"], None).when(x["ahead"].isNotNull(), F.when(~reachable, "range")).when(x["time"].isNotNull(), F.when(x["moment"].isNull(), "date"))
        .when(x["date"].isNotNull() & x["day"].isNull(), "date").when(x["day"].isNotNull() & ~real, "hour")
    )
    return F.struct(due.alias("due"), problem.alias("problem"))


def occurrence(unit: Column, interval: Column, anchor: Column, index: Column) -> Column:
    """The occurrence ``index`` steps after the anchor; months end on their last day and never move the anchor's day."""
    steps = (interval * index).cast("int")
    days = anchor + F.make_dt_interval(days=steps * F.when(unit == "week", 7).otherwise(1))
    months = _midnight(F.add_months(F.to_date(anchor), steps * F.when(unit == "year", 12).otherwise(1)))
    return F.when(unit.isin("day", "week"), days).when(unit.isin("month", "year"), months + (anchor - _midnight(F.to_date(anchor))))


def recurrence(text: Column, reference: Column, start: Column | None = None) -> Column:
    """struct(unit, interval, anchor, problem): the one schedule of a text; several schedules or exceptions are none.

    The anchor is ``start``, or else the first occurrence that is not before ``reference``.
    """
    return rules.given(rules.plain(text), lambda t: rules.given(_cadence(t, reference), lambda x: _rule(x, reference, start)))


def _cadence(t: Column, reference: Column) -> Column:
    """Unit, interval and first day of a text's schedule, and whether it has just one."""
    every, on_day, cadence = r"\bevery\s+(?:(\d+|other)\s+)?(day|week|month|year)s?\b", rf"\bevery\s+({_DAY})\b", rf"\b({'|'.join(_CADENCES)})\b"
    count = _group(t, every, 1)
    at = F.when(t.rlike(every), F.regexp_instr(t, F.lit(every))).when(t.rlike(on_day), F.regexp_instr(t, F.lit(on_day))).otherwise(F.regexp_instr(t, F.lit(cadence)))
    several = F.substr(t, at).rlike(r"\b(?:and|or|except|until)\b") | (F.regexp_count(t, F.lit(r"\bevery\b")) > 1)
    said = F.coalesce(_group(t, r"\b(?:starting|beginning|from)\s+(.+)$", 1), F.when(~t.rlike(every), _group(t, on_day, 1)), F.lit("today"))
    unit = F.coalesce(_group(t, every, 2), F.when(t.rlike(on_day), "week"), _map(_CADENCES)[_group(t, cadence, 1)])
    interval = F.when(count == "other", 2).when(count.isNotNull(), F.coalesce(count.try_cast("int"), F.lit(-1))).otherwise(1)
    first = deadline(F.concat_ws(" ", said, F.regexp_extract(t, _CLOCK, 0)), reference)["due"]
    return F.struct(F.when(rules.recurring(t), unit).alias("unit"), interval.alias("interval"), several.alias("several"), first.alias("first"))


def _rule(x: Column, reference: Column, start: Column | None) -> Column:
    fits = x["interval"].between(1, 1000)
    step = F.when(fits, x["interval"]).otherwise(1)
    anchor = F.when(x["first"] < reference, occurrence(x["unit"], step, x["first"], F.lit(1))).otherwise(x["first"])
    anchor = anchor if start is None else F.coalesce(start, anchor)
    known = x["unit"].isNotNull()
    only = lambda c: F.when(known & fits & ~x["several"] & x["first"].isNotNull(), c)
    if start is not None:
        only = lambda c: F.when(known & fits & ~x["several"] & (start.isNotNull() | x["first"].isNotNull()), c)
    return F.struct(only(x["unit"]).alias("unit"), only(x["interval"]).alias("interval"), only(anchor).alias("anchor"), F.when(known & ~fits, "interval").alias("problem"))
