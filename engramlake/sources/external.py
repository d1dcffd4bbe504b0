"""Conversations, questions and labelled rows from files of other projects, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.functions import values
from engramlake.operators import metrics
from engramlake.sources.log import CATEGORIES

MINUTES_APART = 4
_TURN = "array<struct<dia_id: string, speaker: string, text: string>>"
_ASKED = "array<struct<question: string, evidence: array<string>, category: string>>"
_SAID = "array<array<struct<role: string, content: string, has_answer: boolean>>>"
LONG_HISTORY = f"question_id string, question_type string, question string, question_date string, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions {_SAID}"
SEED = (
    "persona struct<id: string, name: string, split: string>, sessions map<string, string>, memories array<struct<key: string, session: string, category: string, text: string, due: string>>, "
    "queries array<struct<type: string, query: string, gold: map<string, int>, supporting: array<string>, answer: string, aliases: array<string>, as_of: string>>"
)
CASE = "id string, content string, expected_category string, expected_tier string, importance_range array<double>"
QUERY_TYPES = "semantic episodic temporal historical multi_hop entity_relationship conflict preference procedural recency negative_absence unanswerable".split()


def _all_hold(rows: DataFrame, ok: Column, said: str) -> DataFrame:
    """``rows``; a row for which ``ok`` is not true stops the read."""
    return rows.filter(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(said)).cast("boolean")))


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    """(memory, importance_score) of a CSV file with a header; an empty text or a score that is no number stops the read."""
    rows = spark.read.option("header", True).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path)
    if not {"memory", "importance_score"} <= set(rows.columns):
        raise ValueError("the columns memory and importance_score are needed")
    rows = rows.select("memory", F.col("importance_score").try_cast("double").alias("importance_score"))
    return _all_hold(rows, (F.trim("memory") != "") & F.col("importance_score").isNotNull(), "a training row lacks its text or its score")


def labelled_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled sentences from JSON lines; a category that is none, or a range that is none, stops the read."""
    rows = spark.read.schema(CASE).option("mode", "FAILFAST").json(path)
    lo, hi = F.col("importance_range")[0], F.get("importance_range", F.lit(1))
    return _all_hold(rows, F.col("expected_category").isin(*CATEGORIES) & (F.size("importance_range") == 2) & (lo >= 0) & (lo <= hi) & (hi <= 1), "a case is labelled with what cannot be")


def conversations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of a file of conversations whose sessions are fields ``session_N`` beside ``session_N_date_time``.

    Turns: sample_id, session (N), id, speaker, text, said_at, in order by place; turns without a text are left out.
    """
    raw = spark.read.option("multiLine", True).json(path).select("sample_id", F.to_json("conversation").alias("c"), F.to_json("qa").alias("qa"))
    fields = F.explode(F.from_json("c", "map<string, string>")).alias("name", "value")
    each = raw.select("sample_id", "c", fields)
    times = each.filter(F.col("name").rlike(r"^session_\d+_date_time$")).select("sample_id", F.regexp_extract("name", r"(\d+)", 1).cast("int").alias("session"), values.time_of(F.regexp_replace(F.regexp_replace("value", "(?<=[0-9]) am", " AM"), "(?<=[0-9]) pm", " PM")).alias("said_at"))
    turns = each.filter(F.col("name").rlike(r"^session_\d+$")).select("sample_id", F.regexp_extract("name", r"(\d+)", 1).cast("int").alias("session"), F.posexplode(F.from_json("value", _TURN)).alias("place", "t"))
    turns = turns.select("sample_id", "session", "place", F.col("t.dia_id").alias("id"), F.col("t.speaker").alias("speaker"), F.col("t.text").alias("text")).filter("text is not null and trim(text) <> ''")
    asked = raw.select("sample_id", F.posexplode(F.from_json("qa", _ASKED)).alias("n", "q")).select("sample_id", "n", "q.*")
    return turns.join(times, ["sample_id", "session"], "left"), asked


def histories(spark: SparkSession, path: str) -> DataFrame:
    """A row for each turn before a question: question_id, question_type, session, place, role, text, gold, said_at. Questions with a
    session that is dated after them are left out, as their history is no history."""
    raw = spark.read.schema(LONG_HISTORY).option("multiLine", True).json(path)
    at = values.time_of(F.col("question_date"))
    dated = F.transform("haystack_dates", values.time_of)
    raw = raw.withColumns({"asked_at": at, "dates": dated}).filter(F.forall("dates", lambda d: d <= F.col("asked_at")))
    sessions = raw.select("question_id", "question_type", "asked_at", F.posexplode(F.arrays_zip("haystack_session_ids", "dates", "haystack_sessions")).alias("n", "s"))
    turns = sessions.select("question_id", "question_type", "asked_at", F.col("s.haystack_session_ids").alias("session"), F.col("s.dates").alias("said_at"), F.posexplode("s.haystack_sessions").alias("place", "t"))
    return turns.select("question_id", "question_type", "asked_at", "session", "said_at", "place", F.col("t.role").alias("role"), F.col("t.content").alias("text"), F.coalesce("t.has_answer", F.lit(False)).alias("gold"))


def personas(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(memories, queries) of persona files. The memories of a session are said four minutes apart; queries are numbered within their type."""
    seed = spark.read.schema(SEED).option("multiLine", True).option("mode", "FAILFAST").json(path)
    m = seed.select(F.col("persona.id").alias("user_id"), F.col("persona.name").alias("speaker"), F.col("persona.split").alias("split"), "sessions", F.posexplode("memories").alias("place", "m"))
    m = m.select("user_id", "speaker", "split", "place", F.concat_ws("-", "user_id", "m.key").alias("id"), F.col("m.session").alias("session_id"), F.col("m.category").alias("category"), F.col("m.text").alias("content"), values.time_of(F.try_element_at("sessions", F.col("m.session"))).alias("started"))
    m = with_offsets(m, ["user_id", "session_id"], "place", "started").withColumnRenamed("started", "created_at")
    q = seed.select(F.col("persona.id").alias("user_id"), F.col("persona.split").alias("split"), F.posexplode("queries").alias("place", "q")).select("user_id", "split", "place", "q.*")
    n = F.row_number().over(Window.partitionBy("user_id", "type").orderBy("place"))
    q = q.withColumn("query_id", F.format_string("%s-%s-%02d", "user_id", "type", n))
    full = lambda k: F.concat_ws("-", F.col("user_id"), k)
    return m, q.withColumns({"gold": F.transform_keys("gold", lambda k, v: full(k)), "supporting": F.transform("supporting", full), "unanswerable": F.col("type") == "unanswerable"})


def with_offsets(rows: DataFrame, key: list[str], order: str, at: str, minutes: int = MINUTES_APART) -> DataFrame:
    """``rows`` with ``at`` moved on by some minutes for each row before it in its key."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1
    return rows.withColumn(at, F.col(at) + F.make_dt_interval(mins=n * minutes))


def benchmark_problems(memories: DataFrame, queries: DataFrame, personas_wanted: int = 12, each_type: int = 30) -> DataFrame:
    """(rule, n) of a compiled benchmark: how often each rule about its content is broken."""
    gold = queries.select("query_id", "user_id", "type", F.explode(F.map_keys("gold")).alias("id"))
    known = memories.select("id", F.col("user_id").alias("owner"))
    met = gold.join(known, "id", "left")
    spark = memories.sparkSession
    per_type = spark.createDataFrame([(t,) for t in QUERY_TYPES], "type string").join(queries.groupBy("type").agg(F.count("*").alias("n")), "type", "left")
    people = memories.agg(F.count_distinct("user_id").alias("k"))
    return metrics.violations({
        "unknown_gold": met.filter("owner is null"), "foreign_gold": met.filter("owner <> user_id"), "repeated_memory": memories.groupBy("id").count().filter("count > 1"), "repeated_query": queries.groupBy("query_id").count().filter("count > 1"),
        "unknown_type": queries.filter(~F.col("type").isin(*QUERY_TYPES)), "type_count": per_type.filter(F.coalesce("n", F.lit(0)) != each_type), "personas": people.filter(F.col("k") != personas_wanted),
        "answer_without_gold": queries.filter("not unanswerable and size(gold) = 0"), "unanswerable_with_gold": queries.filter("unanswerable and size(gold) > 0"), "grade": queries.filter(F.exists(F.map_values("gold"), lambda g: ~g.between(0, 3))),
        "one_hop": queries.filter("type = 'multi_hop' and size(supporting) < 2"),
    })


def reports(spark: SparkSession, pattern: str) -> DataFrame:
    """(report, key, value): the numbers of flat reports, one JSON object a file, without what only tells how they were made."""
    raw = spark.read.text(pattern, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("report"), F.from_json(F.get_json_object("value", "$.flat"), "map<string, string>").alias("m"))
    flat = raw.select("report", F.explode("m").alias("key", "value")).withColumn("value", F.col("value").try_cast("double"))
    return flat.filter(F.col("value").isNotNull() & metrics.is_metric(F.col("key")))
