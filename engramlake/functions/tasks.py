"""Clauses of a message, and what a clause says about a task, as DataFrame expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions import rules
from engramlake.functions.rules import one_of
from engramlake.functions.words import after, before, begins, ends, first, joined, within

# --- fixed values --------------------------------------------------------------------------------

#: Words that open a clause of its own.
OPENERS = ("i", "my", "we", "our", "remind me", "please", "never", "the", "reschedule", "postpone", "buy", "submit", "send", "pay", "cancel", "skip")
#: Words that do not tell one task from another.
STOP = (
    "i we my our the a an to me please remind need have has had been is was were just already submit submitted complete completed finish finished cancel cancelled canceled "
    "buy bought pay paid send sent book booked schedule scheduled task today tomorrow tonight yesterday by at on in this that next week day days hours minutes am pm every other "
    "daily weekly monthly yearly morning evening monday tuesday wednesday thursday friday saturday sunday occurrence time for of"
).split()
PRONOUNS = ("it", "that", "this", "one")
#: Words for a whole series, and words that keep a clause from telling of a deed.
WHOLE_SERIES = ("entire series", "whole series", "all occurrences", "permanently")
VETOES = (
    "not", "never", "haven't", "hasn't", "hadn't", "isn't", "wasn't", "weren't", "didn't", "don't", "cannot", "can't", "would", "will", "plan to", "want to", "need to", "and", "but", "nor",
)
#: Words that mean one verb, and verbs by what they do to a task: as an order, as a deed of the speaker, and as the state of a thing.
PHRASES = {
    "push back": "postpone", "pushed back": "postponed", "change the deadline for": "reschedule", "called off": "cancelled", "canceled": "cancelled", "wrapped up": "completed", "taken care of": "completed",
    "is now due": "is moved", "was now due": "was moved",
}
VERBS = {
    "rescheduled": {"order": ("reschedule", "postpone", "move"), "deed": ("rescheduled", "postponed", "moved"), "state": ("rescheduled", "postponed", "moved")},
    "cancelled": {"order": ("cancel", "skip"), "deed": ("cancelled",), "state": ("cancelled",)},
    "completed": {"order": (), "deed": ("submitted", "completed", "finished", "paid", "sent", "bought"), "state": ("completed", "finished", "submitted", "done")},
}
#: Words around them: of the speaker, between speaker and verb, before a state, before a thing, and before a time.
SPEAKERS, BETWEEN_DEED, BEING, OWNERS, UNTIL = ("i", "we", "i've", "we've"), ("have", "had", "just", "already", "finally"), ("is", "was", "got"), ("the", "my", "our"), ("to", "until")
UNITS = ("minute", "minutes", "hour", "hours", "day", "days", "week", "weeks")
SPANNED = (*UNITS, "month", "months", "year", "years")

#: Of the words above, and of those that tell of a changed deadline, what is done with and a silence, each text has one that says what was done to a task.
SIGNS = r"reschedul|postpone|move|cancel|skip|submitted|completed|finished|paid|sent|bought|done|push|deadline|called\s+off|wrapped\s+up|taken\s+care|due|reminding"

ACTION = "struct<kind: string, reference: string, due_text: string, scope: string>"
_QUOTED = r"\"[^\"\n]*\"|“[^”\n]*”|(?<!\w)'[^'\n]+'(?!\w)"
_BETWEEN = rf"(?i)[;\n]+|(?<=[.!?])\s+(?={one_of(*OPENERS)}\b)|,?\s+(?:and|but|also)\s+(?={one_of(*OPENERS)}\b)"


def clauses(text: Column) -> Column:
    """The independent clauses of a text; a condition, a sequence or a single clause leaves it whole. Quotations are not split."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s){_QUOTED}|[^\"“']+|."), 0)
    hide = lambda p: F.when((F.length(p) > 1) & p.rlike("^[\"“']"), F.rpad(F.lit("x"), F.length(p), F.lit("x"))).otherwise(p)
    sizes = lambda h: F.zip_with(F.split(h, _BETWEEN, -1), F.regexp_extract_all(h, F.lit(_BETWEEN), 0), lambda p, g: F.struct(F.length(p).alias("n"), F.coalesce(F.length(g), F.lit(0)).alias("gap")))
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<s: int, n: int>>").alias("done"))
    step = lambda acc, x: F.struct((acc["at"] + x["n"] + x["gap"]).alias("at"), F.array_append(acc["done"], F.struct(acc["at"].alias("s"), x["n"].alias("n"))).alias("done"))
    places = rules.given(F.array_join(F.transform(pieces, hide), ""), lambda h: F.aggregate(sizes(h), begin, step)["done"])
    found = F.filter(F.transform(places, lambda x: F.btrim(F.substr(text, x["s"], x["n"]), F.lit(" ,"))), lambda p: p != "")
    scoped = text.rlike(r"(?i)\b(?:if|unless|whether)\b|^\s*(?:first|how to|steps)\b")
    return F.when(scoped, F.array(text)).otherwise(rules.given(found, lambda parts: F.when(F.size(parts) < 2, F.array(text)).otherwise(parts)))


def with_clauses(messages: DataFrame, text: str, at: str) -> DataFrame:
    """A row for each clause: the clause in ``text``, one microsecond after another, with ``segment_index`` and ``segment_count``."""
    rows = messages.withColumn("_clauses", clauses(F.col(text))).withColumn("segment_count", F.size("_clauses"))
    rows = rows.select("*", F.posexplode("_clauses").alias("segment_index", "_clause"))
    later = F.col(at) + F.make_dt_interval(secs=(F.col("segment_index") / 1e6).cast("decimal(18,6)"))
    return rows.withColumns({text: F.col("_clause"), at: later}).drop("_clauses", "_clause")


def key(text: Column) -> Column:
    """The sorted words that name a task: those of the text without its dates, hours and spans, and without STOP."""

    def named(w: Column) -> Column:
        at = lambda i: F.coalesce(F.get(w, i), F.lit(""))
        number = lambda x: x.rlike(r"^\d+$")
        span = lambda i: within(at(i), ("in", "every")) & number(at(i + 1)) & within(at(i + 2), SPANNED)

        def dated(x: Column, i: Column) -> Column:
            clock = within(at(i - 1), ("at", "by")) & x.rlike(r"^\d{1,2}(:\d{2})?(am|pm)?$")
            return x.rlike(r"^\d{4}-\d{2}-\d{2}(t.*)?$") | clock | ((i > 0) & span(i - 1)) | ((i > 1) & span(i - 2))

        left = F.filter(F.transform(w, lambda x, i: F.when(~dated(x, i), x)), lambda x: x.isNotNull())
        parts = F.flatten(F.transform(left, lambda x: F.regexp_extract_all(x, F.lit("[a-z0-9]+"), 0)))
        return F.array_sort(F.array_except(F.array_distinct(parts), F.array(*map(F.lit, STOP))))

    said = F.regexp_replace(rules.plain(text), r"\b(today|tomorrow|yesterday)'s\b", "")
    words = F.transform(F.array_remove(F.split(said, r"\s+"), ""), lambda x: F.regexp_replace(x, r"[.,;!?]+$", ""))
    return rules.given(words, named)


def _unowned(w: Column) -> Column:
    """A thing without the article or pronoun before it."""
    return F.when((F.size(w) > 1) & within(F.get(w, F.lit(0)), OWNERS), after(w, 1)).otherwise(w)


def action(text: Column) -> Column:
    """struct(kind, reference, due_text, scope): what a clause says was done to a task; null where it says nothing.

    ``kind``: completed, cancelled or rescheduled. The words of a clause are read around its verb (VERBS): nothing but
    "please" before an order, a speaker before a deed, a thing and a form of "to be" before a state. What stands
    behind an order or a deed is its thing, and behind "to", "until" or "by" and a span, when it is due.
    Questions, negations, plans and several clauses say nothing, but for "X is not due A but B".
    """
    said = F.regexp_replace(rules.plain(text), r"[.!]+\z", "")
    for phrase, verb in PHRASES.items():
        said = F.regexp_replace(said, rf"\b{phrase}\b", verb)
    series = rules.alone(*WHOLE_SERIES)
    split = lambda c: F.array_remove(F.split(c, r"\s+"), "")
    plain = lambda s: ~s.rlike(rf"{rules.alone(*VETOES)}|[;\n]|[.!]\s+\w")
    told = lambda s: rules.given(split(F.regexp_replace(s, series, "")), lambda w: _told(w, F.when(s.rlike(series), "series")))
    found = rules.given(said, lambda s: F.when(~rules.uncertain(s), F.coalesce(rules.given(split(s), _correction), F.when(plain(s), told(s)))))
    return F.when(text.rlike(f"(?iu){SIGNS}"), found)


def _made(kind: Column, reference: Column, due: Column, scope: Column) -> Column:
    return F.struct(kind.alias("kind"), reference.alias("reference"), due.alias("due_text"), scope.alias("scope")).cast(ACTION)


def _correction(w: Column) -> Column:
    """A due date that is said to be another one: a thing "is not due" one time, "but" another."""
    none = F.lit(None).cast("string")

    def of(due: Column) -> Column:
        left, right = F.slice(w, F.lit(1), due), after(w, due + 1)
        negated = F.when(ends(left, "is", "not"), 2).when(ends(left, "is", "no", "longer"), 3)
        thing = _unowned(before(left, F.coalesce(negated, F.lit(0))))

        def turned(at: Column) -> Column:
            rest = after(right, at + 1)
            skipped = F.coalesce(first(rest, lambda x, i: ~x.isin("is", "now", "due")), F.size(rest))
            new = after(rest, skipped)
            certain = ~F.exists(new, lambda x: x.isin("not", "never", "no", "and", "or", "but"))
            return F.when(negated.isNotNull() & (at > 0) & (F.size(thing) > 0) & (F.size(new) > 0) & certain, _made(F.lit("rescheduled"), joined(thing), joined(new), none))

        return rules.given(first(right, lambda x, i: F.rtrim(x, F.lit(",")).isin("but", "instead")), turned)

    return rules.given(first(w, lambda x, i: x == "due"), of)


def _told(w: Column, scope: Column) -> Column:
    """The first verb of a clause around which a voice is complete, or else a changed deadline, a thing done with, or a silence."""

    def voice(word: Column, i: Column) -> Column:
        left, right = F.slice(w, F.lit(1), i), after(w, i + 1)
        ordered = (i == 0) | begins(left, "please") & (i == 1)
        speaks = (i > 0) & within(F.get(left, F.lit(0)), SPEAKERS) & F.forall(after(left, 1), lambda x: x.isin(*BETWEEN_DEED))
        sure = F.when(ends(left, "already"), before(left, 1)).otherwise(left)
        be = F.when(ends(sure, "has", "been"), 2).when(within(F.element_at(F.concat(F.array(F.lit("")), sure), -1), BEING), 1)
        thing = _unowned(before(sure, F.coalesce(be, F.lit(0))))
        is_so = be.isNotNull() & (F.size(thing) > 0)
        out = F.lit(None).cast(ACTION)
        for kind, forms in VERBS.items():
            of = F.lit(kind)
            if kind == "rescheduled":
                moved, state = _moved(right, of, scope), _made(of, joined(thing), joined(_when(right)), scope)
            else:
                moved, state = F.when(F.size(right) > 0, _made(of, joined(right), F.lit(""), scope)), F.when(F.size(right) == 0, _made(of, joined(thing), F.lit(""), scope))
            told = F.coalesce(F.when(within(word, forms["order"]) & ordered, moved), F.when(within(word, forms["deed"]) & speaks, moved), F.when(within(word, forms["state"]) & is_so, state))
            out = F.coalesce(out, told)
        return out

    found = F.get(F.filter(F.transform(w, voice), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(found, _changed_deadline(w, scope), _done_with(w, scope), F.when(begins(w, "stop", "reminding", "me", "to") & (F.size(w) > 4), _made(F.lit("cancelled"), joined(after(w, 4)), F.lit(""), F.lit("series"))))


def _when(w: Column) -> Column:
    """The words of a time: behind the last "to" or "until", without a "for" before it."""
    cut = F.coalesce(F.array_max(F.transform(w, lambda x, i: F.when(within(x, UNTIL), i + 1))), F.lit(0))
    return rules.given(after(w, cut), lambda x: F.when(begins(x, "for"), after(x, 1)).otherwise(x))


def _moved(rest: Column, kind: Column, scope: Column) -> Column:
    """What is moved, which ends at "from", and to when; a span behind "by" is a delay."""

    def of(cuts: Column) -> Column:
        earliest, last = F.coalesce(F.array_min(cuts["at"]), F.size(rest)), F.array_max(cuts["at"])
        thing = F.slice(rest, F.lit(1), earliest)
        thing = F.slice(thing, F.lit(1), F.coalesce(first(thing, lambda x, i: (x == "from") & (i > 0)), F.size(thing)))
        due = F.when(last.isNotNull(), joined(after(rest, last + 1))).otherwise("")
        delay = F.when(F.exists(cuts, lambda x: x["by"]), F.lit("delay ")).otherwise("")
        return F.when(F.size(thing) > 0, _made(kind, joined(thing), F.concat(delay, due), scope))

    ahead = lambda i, n: F.get(rest, i + n)
    by = lambda x, i: (x == "by") & F.coalesce(ahead(i, 1).rlike(r"^\d+$") & within(ahead(i, 2), UNITS), F.lit(False))
    cuts = F.filter(F.transform(rest, lambda x, i: F.struct(i.alias("at"), by(x, i).alias("by"), (within(x, UNTIL) | by(x, i)).alias("cuts"))), lambda x: x["cuts"] & (x["at"] > 0))
    return rules.given(cuts, of)


def _changed_deadline(w: Column, scope: Column) -> Column:
    """ "The deadline for X" is now, or has changed or moved to, another time."""
    bare = F.when(begins(w, "the"), after(w, 1)).otherwise(w)
    named = (F.get(bare, F.lit(0)) == "deadline") & F.get(bare, F.lit(1)).isin("for", "of")

    def of(rest: Column) -> Column:
        turns = lambda x, i: (i > 0) & ((x.isin("changed", "moved")) | ((x == "now") & (F.get(rest, i - 1) == "is")))
        at = first(rest, turns)
        left = F.slice(rest, F.lit(1), at)
        thing = F.when(ends(left, "has") | ends(left, "is"), before(left, 1)).otherwise(left)
        due = _when(after(rest, at + 1))
        return F.when(named & at.isNotNull() & (F.size(thing) > 0) & (F.size(due) > 0), _made(F.lit("rescheduled"), joined(thing), joined(due), scope))

    return rules.given(after(bare, 2), of)


def _done_with(w: Column, scope: Column) -> Column:
    """ "I am done with X"."""
    spoken = F.when(begins(w, "i", "am") | begins(w, "we", "are"), 2).when(within(F.get(w, F.lit(0)), ("i'm", "we're")), 1)
    rest = after(w, F.coalesce(spoken, F.lit(0)))
    return F.when(spoken.isNotNull() & begins(rest, "done", "with") & (F.size(rest) > 2), _made(F.lit("completed"), joined(after(rest, 2)), F.lit(""), scope))


def outcome(act: Column) -> Column:
    """completed or cancelled, of an action; null for one that only moves a task."""
    return F.when(act["kind"] != "rescheduled", act["kind"])


def refers(task_key: Column, reference_key: Column) -> Column:
    """How a reference names a task: 2 by all its words, 1 by a part of them with the same numbers, 0 not at all.

    A reference that names nothing (a bare pronoun) may mean any task of its session: 3.
    """
    digits = lambda c: F.filter(c, lambda w: w.rlike("^[0-9]+$"))
    bare = F.size(F.array_except(reference_key, F.array(*map(F.lit, PRONOUNS)))) == 0
    part = (F.size(F.array_except(reference_key, task_key)) == 0) & (digits(reference_key) == digits(task_key))
    tiers = ((bare, 3), (task_key == reference_key, 2), (part, 1))
    return reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed(tiers), F.lit(0))
