"""Small functions of values: nested metadata, digests, texts to compare, times from other sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramlake.functions import rules, schedule

#: The forms in which other sources write a time.
TIME_FORMS = ("yyyy/MM/dd HH:mm", "h:mm a 'on' d MMMM, yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def redacted_json(text: Column) -> Column:
    """A JSON text with every string in it redacted, however deep it lies; keys are strings too, and hold nothing sensitive."""
    pieces = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*"|[^"]+'), 0)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith('"'), rules.redact(p)[0]).otherwise(p)), "")


def digest(columns: dict[str, Column]) -> Column:
    """A sha256 of values by name, the same for every order of the names."""
    return F.sha2(F.to_json(F.struct(*[columns[n].alias(n) for n in sorted(columns)])), 256)


def compared(text: Column) -> Column:
    """A text as answers are compared: its words in lower case, with single spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), 0), " ")


def answer_forms(answer: Column, others: Column) -> Column:
    """The different forms of an answer, to be found in a text."""
    every = F.filter(F.transform(F.concat(F.array(answer), F.coalesce(others, F.array().cast("array<string>"))), compared), lambda x: x != "")
    return F.array_distinct(every)


def sentence_form(text: Column) -> Column:
    """A training sentence without the number of its example."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\s*\(example\s+\d+\)", ""), r"\s+", " "))


def mentions_value(text: Column, value: Column) -> Column:
    """Whether a value stands in a text as words of its own."""
    return rules.contains_phrase(text, value) & (F.coalesce(F.trim(value), F.lit("")) != "")


def time_of(text: Column) -> Column:
    """A time from any of the known forms, which may have a weekday in brackets; null where none fits. An offset is taken off, so that the result is UTC."""
    offset = F.regexp_extract(text, r"([+-]\d{2}):?(\d{2})$|Z$", 0)
    bare = F.regexp_replace(F.regexp_replace(text, r"(?<=\d)(?:Z|[+-]\d{2}:?\d{2})$", ""), r"\.\d+$|\s*\([A-Za-z]{3}\)", "")
    parsed = F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in TIME_FORMS]).cast("timestamp_ntz")
    minutes = F.when(offset.rlike(r"^[+-]"), (F.substring(offset, 2, 2).cast("int") * 60 + F.regexp_extract(offset, r"(\d{2})$", 1).cast("int")) * F.when(offset.startswith("-"), -1).otherwise(1)).otherwise(0)
    return parsed - F.make_dt_interval(mins=minutes)


def advanced(rule: Column) -> Column:
    """A rule (unit, interval, anchor, index) one occurrence on, with the time of that one."""
    at = schedule.occurrence(rule["unit"], rule["interval"], rule["anchor"], rule["index"] + 1)
    return F.struct(rule["unit"].alias("unit"), rule["interval"].alias("interval"), rule["anchor"].alias("anchor"), (rule["index"] + 1).alias("index"), at.alias("next_due_at"))


def selects(chosen: Column, due: Column, scheduled: Column) -> Column:
    """Whether a day or a moment, as text, means an occurrence that is due or was planned then."""
    day, moment = F.length(chosen) == 10, chosen.try_cast("timestamp_ntz")
    on = lambda t: F.to_date(t) == chosen.try_cast("date")
    return F.when(day, on(due) | on(scheduled)).otherwise((moment == due) | (moment == scheduled))
