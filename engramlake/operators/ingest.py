"""From messages to records: redaction, category, claim, schedule, features, importance, tier and expiry in one select.

Messages: id, user_id, session_id, role, content, created_at (a time without a zone), and, where there,
due_at, confidence, source_priority, interaction, access_count, has_relations. Nothing stops a job for
one bad message: the column ``problem`` says why a record must not be kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions import claims, rules, schedule, scoring, tasks

_DEFAULTS = {"role": ("string", "user"), "due_at": ("timestamp_ntz", None), "confidence": ("double", 0.5), "source_priority": ("double", 0.0), "interaction": ("double", 0.0), "access_count": ("bigint", 0), "has_relations": ("boolean", False)}
#: A time word without which a statement may hold beyond its day.
DATED = ("used to", "previously", "formerly", "yesterday", "tomorrow", "today", r"(?:last|next)\s+(?:week|month|year)")


def _or_default(messages: DataFrame) -> DataFrame:
    given = {n: (F.coalesce(F.col(n).cast(t), F.lit(v)) if v is not None else F.col(n).cast(t)) if n in messages.columns else F.lit(v).cast(t) for n, (t, v) in _DEFAULTS.items()}
    return messages.withColumns(given)


def reconcilable(content: Column, role: Column, category: Column) -> Column:
    """Certain, undated statements of the user that may meet others: facts, preferences and procedures."""
    return (role == "user") & category.isin(*scoring.DURABLE) & ~rules.uncertain(content) & ~rules.says(content, rules.alone(*DATED))


def _problem(valid: dict[str, Column]) -> Column:
    """The name of the first check that fails."""
    return reduce(lambda rest, kv: F.when(~F.coalesce(kv[1], F.lit(False)), kv[0]).otherwise(rest), reversed(valid.items()), F.lit(None).cast("string"))


def process(messages: DataFrame, now: Column, model: Column | None = None) -> DataFrame:
    """Records of messages, as of ``now``. ``model`` is an importance model's score by column, blended with the rules' score.

    Adds to the messages: content (redacted), privacy, category, claim, claims, action, task_status, recurrence,
    due, next_due_at, importance, tier, expires_at, archive_after, reconcilable and problem.
    """
    c = F.col
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.trim(x), F.lit("")) == "" for x in ("content", "user_id", "session_id")])
    m = _or_default(messages).withColumn("_blank", blank)
    text, found = rules.redact(c("content"))
    m = m.withColumns({"content": text, "privacy": found})
    m = m.withColumns({"_said": claims.claims_of(c("content")), "action": tasks.action(c("content")), "_own": rules.self_disclosure(c("content"))})
    speaks = (c("role") == "user") & ~c("has_relations") & c("_own")
    m = m.withColumn("category", rules.category(c("content"), c("_said.one"), c("_said.all"), c("action"), speaks))
    told = (c("role") == "user") & (((c("category") == "temporary") & c("has_relations")) | ((c("category") == "episodic") & (c("_said.one.predicate") == "residence")))
    m = m.withColumn("category", F.when(F.coalesce(told, F.lit(False)), "semantic").otherwise(c("category")))
    task = c("category") == "task"
    m = m.withColumns({
        "claim": F.when((c("role") == "user") & c("category").isin("semantic", "preference"), c("_said.one")), "claims": c("_said.all"), "_recurs": task & rules.recurring(c("content")),
        "task_status": F.when(task, "active"),
    })
    m = m.withColumns({"_rule": F.when(c("_recurs"), schedule.recurrence(c("content"), c("created_at"), c("due_at"))), "_due": F.when(task & ~c("_recurs"), schedule.deadline(c("content"), c("created_at")))})
    m = m.withColumns({
        "recurrence": F.when(c("_rule.unit").isNotNull(), F.struct(c("_rule.unit").alias("unit"), c("_rule.interval").alias("interval"), c("_rule.anchor").alias("anchor"), F.lit(0).alias("index"))),
        "next_due_at": c("_rule.anchor"), "due": F.when(task & ~c("_recurs"), F.coalesce(c("due_at"), c("_due.due"))),
    })
    signals = scoring.features(c("content"), c("category"), c("created_at"), now, c("access_count"), c("interaction"))
    m = m.withColumn("features", F.struct(*[v.alias(k) for k, v in signals.items()]))
    score = scoring.importance({k: c(f"features.{k}") for k in signals})
    m = m.withColumn("importance", score if model is None else scoring.hybrid_importance(model, score, c("category")))
    closed = F.lit(False)
    archive = scoring.should_archive(now, c("created_at"), c("category"), c("access_count"), c("importance"))
    m = m.withColumn("tier", scoring.tier(c("category"), c("importance"), closed, c("_recurs"), archive))
    m = m.withColumns({
        "expires_at": scoring.expiry(c("category"), c("tier"), closed, c("_recurs"), c("due"), c("created_at"), c("_own") & (c("role") == "user")),
        "archive_after": F.when(c("tier") == "long_term", c("created_at") + F.make_dt_interval(days=F.lit(scoring.ARCHIVE_DAYS))),
        "reconcilable": reconcilable(c("content"), c("role"), c("category")),
        "problem": F.coalesce(
            _problem({
                "blank": ~c("_blank"), "confidence": c("confidence").between(0, 1), "source_priority": c("source_priority").between(0, 100),
                "due_at": c("due_at").isNull() | task | (F.coalesce(c("action.kind"), F.lit("")) == "rescheduled"),
            }), c("_rule.problem"), c("_due.problem"),
        ),
    })
    m = m.drop("_blank", "_said", "_own", "_recurs", "_rule", "_due")
    return _settled(m, [x for x in m.columns if x not in messages.columns or x in ("content", *_DEFAULTS)])


def _settled(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` as the output of a generator: a later filter on one of them is not pushed below, where it would repeat
    all that the column is made of, for each of its uses."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns))))


def process_clauses(messages: DataFrame, now: Column, model: Column | None = None) -> DataFrame:
    """As ``process``, with a record for each independent clause of a message; the id of a later clause has its number behind it."""
    parts = tasks.with_clauses(messages, "content", "created_at")
    named = F.when(F.col("segment_index") == 0, F.col("id").cast("string")).otherwise(F.concat_ws("#", F.col("id").cast("string"), F.col("segment_index").cast("string")))
    return process(parts.withColumn("id", named), now, model)


def once_each(records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Records by id, each taken in once; ``problem`` marks an id that comes again with another owner or content.

    ``known``: records that are already kept (id, user_id, content); a repeat of one of them is left out.
    """
    mine = F.struct("user_id", "content")
    seen = records.select("id", "created_at", mine.alias("what"))
    if known is not None:
        first = F.lit("0001-01-01").cast("timestamp_ntz")
        seen = seen.unionByName(known.select("id", first.alias("created_at"), mine.alias("what")))
    first = seen.groupBy("id").agg(F.min_by("what", F.struct("created_at", "what")).alias("_first"))
    out = records.join(first, "id").withColumn("_other", F.col("_first") != mine)
    if known is not None:
        out = out.join(known.select("id", F.lit(True).alias("_kept")).distinct(), "id", "left").filter("_kept is null or _other").drop("_kept")
    out = out.withColumn("problem", F.when(F.col("_other"), "id").otherwise(F.col("problem"))).drop("_first", "_other")
    same = out.filter("problem is null or problem <> 'id'").dropDuplicates(["id"])
    return same.unionByName(out.filter("problem = 'id'"))
