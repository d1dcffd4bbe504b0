"""The append-only revision log: reading, appending, and what it says now and said before.

A revision log is a DataFrame with an id, a position (which orders revisions) and any other columns.
All operators take the names of these columns, and partition by the id alone.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, MapType, StringType, StructField, StructType, TimestampType

from engramlake.functions import rules, scoring

CATEGORIES = ("semantic", "episodic", "procedural", "preference", "task", "temporary")
TIERS = ("working", "short_term", "long_term", "archive")
CLOSED = ("completed", "cancelled")

_CLAIM = StructType([StructField(n, StringType()) for n in ("subject", "predicate", "value", "kind")] + [StructField("positive", StringType()), StructField("exclusive", StringType())])
REVISION = StructType(
    [StructField("log_pos", LongType()), *[StructField(n, StringType()) for n in ("id", "user_id", "session_id", "role", "content", "category", "tier")]]
    + [StructField(n, TimestampType()) for n in ("created_at", "updated_at", "recorded_at", "expires_at", "archive_after", "due_at", "last_accessed_at", "first_observed_at", "last_observed_at", "last_confirmed_at")]
    + [StructField("confidence", DoubleType()), StructField("importance_score", DoubleType()), StructField("source_priority", DoubleType()), StructField("access_count", LongType())]
    + [StructField("features", MapType(StringType(), DoubleType())), StructField("claim", _CLAIM)]
    + [StructField(n, StringType()) for n in ("task_status", "memory_status", "superseded_by", "consolidated_into", "summary", "source_metadata")]
    + [StructField(n, ArrayType(StringType())) for n in ("conflict_ids", "evidence_ids", "evidence_session_ids")]
)
REQUIRED = ("id", "user_id", "session_id", "content", "category", "created_at")


#: What a revision of an older form lacks, and what it then counts as.
DEFAULTS = {"role": "user", "tier": "short_term", "confidence": 0.5, "importance_score": 0.0, "access_count": 0, "memory_status": "active", "source_priority": 0.0}


def read_log(spark: SparkSession, path: str, check_owners: bool = True) -> DataFrame:
    """JSON lines in the schema of a revision, older ones with defaults; a malformed line, a missing field or an id with two owners stops the read."""
    rows = spark.read.schema(REVISION).option("mode", "FAILFAST").json(path)
    missing = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a revision lacks {c}"))) for c in REQUIRED]
    rows = with_defaults(rows.filter(F.coalesce(*missing, F.lit(True)).cast("boolean")))
    return with_one_owner(rows) if check_owners else rows


def with_defaults(rows: DataFrame) -> DataFrame:
    """Older revisions as new ones: what they lack has its default, and what was never recorded was recorded when it was made."""
    given = {c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items() if c in rows.columns}
    times = {"updated_at": F.coalesce("updated_at", "created_at"), "recorded_at": F.coalesce("recorded_at", "updated_at", "created_at")}
    return rows.withColumns(given | {c: v for c, v in times.items() if c in rows.columns})


def with_one_owner(rows: DataFrame) -> DataFrame:
    """``rows``, unless an id belongs to more than one user."""
    owners = rows.groupBy("id").agg(F.min("user_id").alias("lo"), F.max("user_id").alias("hi"))
    bad = owners.filter("lo <> hi").limit(1).collect()
    if bad:
        raise ValueError(f"id {bad[0]['id']} belongs to more than one user")
    return rows


def problems(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, problem) of rows that must not be appended: blank fields, numbers out of bounds, or an id that another user has."""
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.trim(c), F.lit("")) == "" for c in ("id", "user_id", "session_id", "content")])
    fine = lambda c, hi: F.coalesce(F.col(c).between(0, hi) & ~F.isnan(c), F.lit(True)) if c in rows.columns else F.lit(True)
    own = F.when(blank, "blank").when(~fine("confidence", 1), "confidence").when(~fine("source_priority", 100), "source_priority")
    found = rows.select("id", own.alias("problem")).filter("problem is not null")
    each = rows.select("id", "user_id") if known is None else rows.select("id", "user_id").unionByName(known.select("id", "user_id"))
    torn = each.groupBy("id").agg(F.count_distinct("user_id").alias("k")).filter("k > 1").join(rows.select("id").distinct(), "id")
    return found.unionByName(torn.select("id", F.lit("owner").alias("problem")))


def append(rows: DataFrame, path: str, now: dt.datetime, known: DataFrame | None = None) -> None:
    """One write of a whole batch, all with one recorded_at; nothing is written if any row has a problem."""
    bad = problems(rows, known).limit(3).collect()
    if bad:
        raise ValueError("; ".join(f"{r['id']}: {r['problem']}" for r in bad))
    save(rows, path, now)


def save(rows: DataFrame, path: str, now: dt.datetime) -> None:
    """As ``append``, without looking."""
    rows.withColumn("recorded_at", F.lit(now)).write.mode("append").json(path)


def replace(rows: DataFrame, root: str) -> str:
    """Writes a whole new version of a table below ``root`` and then points to it; readers see the old one or the new one, never a part.

    Versions are folders; the pointer is a folder of one line, written last under a name of its own.
    """
    spark, version = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{root}/versions/{version}")
    order = _pointers(spark, root)
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.json(f"{root}/pointers/{len(order):09d}-{version}")
    return version


def _pointers(spark: SparkSession, root: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []
    done = [p for p in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(p.getName() for p in done)


def current_version(spark: SparkSession, root: str) -> DataFrame:
    """The table that the newest pointer below ``root`` names."""
    return spark.read.parquet(f"{root}/versions/{_pointers(spark, root)[-1].split('-', 1)[1]}")


def latest(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The last revision of each id; of each task's rows of an id only the last one is shuffled."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), position).alias("_x"))
    return last.select(key, "_x.*").select(*rows.columns)


def history(rows: DataFrame, key: str, position: str, value) -> DataFrame:
    """All revisions of one id in log order, numbered from 1."""
    w = Window.partitionBy(key).orderBy(position)
    return rows.filter(F.col(key) == value).withColumn("revision", F.row_number().over(w))


def statistics(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of ``column``, with a row of zero for each of ``values`` that does not occur."""
    spark = rows.sparkSession
    all_values = spark.createDataFrame([(v,) for v in values], f"{column} string")
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(all_values).join(counted, column, "full_outer").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def is_visible(now: Column, expires_at: str = "expires_at", status: str = "memory_status", task: str = "task_status", expired: bool = False, history: bool = False, resolved: bool = False) -> Column:
    """Not expired (an expiry of just now has passed), active, and no closed task; each of the three can be let through."""
    fresh = F.lit(expired) | F.col(expires_at).isNull() | (F.col(expires_at) > now)
    active = F.lit(history) | F.col(status).isNull() | (F.col(status) == "active")
    open_task = F.lit(resolved) | F.col(task).isNull() | ~F.col(task).isin(*CLOSED)
    return fresh & active & open_task


def in_session(session: str, own: str = "session_id", evidence: str = "evidence_session_ids") -> Column:
    """The record's own session or one of its evidence."""
    return (F.col(own) == session) | F.coalesce(F.array_contains(evidence, session), F.lit(False))


def matching(rows: DataFrame, user: str | None = None, session: str | None = None, category: str | None = None, tier: str | None = None) -> DataFrame:
    """Rows with all that is asked for; a session also counts where it is among a record's evidence."""
    for column, wanted in (("user_id", user), ("category", category), ("tier", tier)):
        if wanted is not None:
            rows = rows.filter(F.col(column) == wanted)
    return rows if session is None else rows.filter(in_session(session) if "evidence_session_ids" in rows.columns else F.col("session_id") == session)


def archive_view(rows: DataFrame, now: Column) -> DataFrame:
    """Rows as a reader sees them: long-term ones that were idle for long show as archived; the log stays as it is."""
    active = scoring.last_activity("created_at", "last_accessed_at", "last_observed_at")
    stale = (F.col("tier") == "long_term") & scoring.should_archive(now, active, F.col("category"), F.col("access_count"), F.col("importance_score"))
    return rows.withColumns({"tier": F.when(stale, "archive").otherwise(F.col("tier")), "archive_after": F.when(~stale, F.col("archive_after"))})


def touched(rows: DataFrame, now: Column) -> DataFrame:
    """The revisions that an access makes."""
    return rows.withColumns({"access_count": F.col("access_count") + 1, "last_accessed_at": now, "updated_at": now})


def listed(rows: DataFrame, now: Column, limit: int | None = None, **asked) -> DataFrame:
    """Visible records with all that is asked for (``matching``), the newest first; ``expired``, ``history`` and ``resolved`` let more through."""
    if limit is not None and limit < 0:
        raise ValueError("a limit of 0 or more")
    through = {k: asked.pop(k) for k in ("expired", "history", "resolved") if k in asked}
    out = matching(archive_view(rows.filter(is_visible(now, **through)), now), **asked).orderBy(F.col("created_at").desc(), "id")
    return out if limit is None else out.limit(limit)


def searched(rows: DataFrame, text: str, now: Column, limit: int | None = None, **asked) -> DataFrame:
    """Visible records with all that is asked for that share a word with ``text``, and their ``score``; best, newest and then smallest id first."""
    if limit is not None and limit < 0:
        raise ValueError("a limit of 0 or more")
    through = {k: asked.pop(k) for k in ("expired", "history", "resolved") if k in asked}
    seen = matching(archive_view(rows.filter(is_visible(now, **through)), now), **asked)
    wanted = rules.tokens(F.lit(text))
    shared = F.size(F.array_intersect(rules.tokens(F.col("content")), wanted))
    recency = scoring.half_life(F.coalesce("last_observed_at", "created_at"), now)
    score = scoring.rank_score(shared / F.greatest(F.size(wanted), F.lit(1)), F.col("category"), F.col("tier"), recency, F.col("importance_score"))
    out = seen.filter(shared > 0).withColumn("score", score).orderBy(F.col("score").desc(), F.col("created_at").desc(), "id")
    return out if limit is None else out.limit(limit)


def without_repeats(rows: DataFrame, key: str, position: str, columns: list[str]) -> DataFrame:
    """Drops a revision equal to the one just before it of its id; A, B, A stays."""
    w = Window.partitionBy(key).orderBy(position)
    now, before = F.struct(*columns), F.lag(F.struct(*columns)).over(w)
    return rows.withColumn("_same", before.isNotNull() & now.eqNullSafe(before)).filter("not _same").drop("_same")


def known_intervals(rows: DataFrame, key: str, position: str, known_at: str) -> DataFrame:
    """Adds known_from and known_to: from this revision's time to the next one's."""
    w = Window.partitionBy(key).orderBy(position)
    return rows.withColumn("known_from", F.col(known_at)).withColumn("known_to", F.lead(known_at).over(w))


def during(at: Column, start: str, end: str) -> Column:
    """Whether ``at`` lies in a half-open interval that may have no end."""
    return (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at))


def islands(rows: DataFrame, key: str, position: str, state: Column) -> DataFrame:
    """Numbers the episodes of each id: a new one wherever ``state`` changes."""
    w = Window.partitionBy(key).orderBy(position)
    flagged = rows.withColumn("_state", state)
    changed = F.when(F.col("_state").eqNullSafe(F.lag("_state").over(w)), 0).otherwise(1)
    return flagged.withColumn("_new", changed).withColumn("episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_state", "_new")


#: The columns of an export as a table.
EXPORTED = ("id", "user_id", "session_id", "role", "content", "category", "tier", "importance_score", "confidence", "created_at", "updated_at", "expires_at")


def exported(rows: DataFrame, user: str) -> DataFrame:
    return rows.filter(F.col("user_id") == user).select(*EXPORTED)


def export_csv(rows: DataFrame, user: str, path: str) -> None:
    exported(rows, user).write.option("header", True).csv(path)


def export_json(rows: DataFrame, user: str, path: str) -> None:
    rows.filter(F.col("user_id") == user).write.json(path)


def without_user(rows: DataFrame, user: str, *derived: DataFrame) -> DataFrame | tuple[DataFrame, ...]:
    """The log after a user's revisions are deleted, and each table that was derived from it without theirs."""
    left = [df.filter(F.col("user_id") != user) for df in (rows, *derived)]
    return left[0] if not derived else tuple(left)
