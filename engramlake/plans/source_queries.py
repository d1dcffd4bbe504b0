"""Files of other projects, written by the query itself and read back; small functions of values."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.functions import rules, values
from engramlake.operators import evaluate, graph, graph_build, search
from engramlake.plans.registry import at, query, table
from engramlake.session import shared_folder
from engramlake.sources import external, log

NOW = "2026-09-26 12:00:00"


def _file(spark: SparkSession, rows: list[dict]) -> str:
    """JSON lines in a folder of the shared one."""
    path = f"{shared_folder(spark)}/file-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").coalesce(1).write.text(path)
    return path


_TALK = {
    "sample_id": "c1", "conversation": {"session_1": [{"dia_id": "D1:1", "speaker": "Ann", "text": "Hi"}, {"dia_id": "D1:2", "speaker": "Bob"}], "session_1_date_time": "1:56 pm on 8 May, 2023", "session_2": [{"dia_id": "D2:1", "speaker": "Bob", "text": "Yes"}], "session_2_date_time": "9:05 am on 9 May, 2023"},
    "qa": [{"question": "Who?", "evidence": ["D1:1", "D2:1"], "category": 1}],
}


@query("""SELECT kind, id, said_at::TIMESTAMP AS said_at FROM (VALUES ('turn', 'D1:1', '2023-05-08 13:56:00'), ('turn', 'D2:1', '2023-05-09 09:05:00'), ('evidence', 'D1:1', NULL), ('evidence', 'D2:1', NULL)) t(kind, id, said_at)""")
def conversation_source(spark: SparkSession, d: str) -> DataFrame:
    turns, asked = external.conversations(spark, _file(spark, [_TALK]))
    none = F.lit(None).cast("timestamp_ntz").alias("said_at")
    return turns.select(F.lit("turn").alias("kind"), "id", "said_at").unionByName(asked.select(F.lit("evidence").alias("kind"), F.explode("evidence").alias("id"), none))


def _asked(i: str, at_: str, first: str) -> dict:
    turns = [{"role": "user", "content": f"a {i}", "has_answer": True}, {"role": "assistant", "content": f"b {i}"}]
    return {"question_id": i, "question_type": "t", "question": "?", "question_date": at_, "haystack_dates": [first], "haystack_session_ids": ["s"], "haystack_sessions": [turns]}


@query("SELECT question_id, place, role, gold FROM (VALUES ('q1', 0, 'user', true), ('q1', 1, 'assistant', false)) t(question_id, place, role, gold)")
def history_source(spark: SparkSession, d: str) -> DataFrame:
    """A question whose history is dated after it is left out."""
    path = _file(spark, [_asked("q1", "2023/05/20 (Sat) 10:00", "2023/05/01 (Mon) 09:00"), _asked("q2", "2023/05/20 (Sat) 10:00", "2023/06/01 (Thu) 09:00")])
    return external.histories(spark, path).select("question_id", "place", "role", "gold")


_PERSONA = {
    "persona": {"id": "p1", "name": "Ann", "split": "dev"}, "sessions": {"s1": "2026-01-05T09:00:00+00:00"}, "memories": [{"key": "a", "session": "s1", "category": "semantic", "text": "A"}, {"key": "b", "session": "s1", "category": "semantic", "text": "B"}],
    "queries": [{"type": "semantic", "query": "?", "gold": {"a": 3}, "supporting": ["a"], "answer": "A", "aliases": []}, {"type": "semantic", "query": "!", "gold": {"z": 1}, "supporting": [], "answer": "B", "aliases": []}],
}


@query("""SELECT id, created_at::TIMESTAMP AS created_at FROM (VALUES ('p1-a', '2026-01-05 09:00:00'), ('p1-b', '2026-01-05 09:04:00')) t(id, created_at)""")
def persona_memories(spark: SparkSession, d: str) -> DataFrame:
    return external.personas(spark, _file(spark, [_PERSONA]))[0].select("id", "created_at")


@query("""SELECT rule, n::BIGINT AS n FROM (VALUES ('unknown_gold', 1), ('foreign_gold', 0), ('repeated_memory', 0), ('repeated_query', 0), ('unknown_type', 0), ('type_count', 11), ('personas', 0), ('answer_without_gold', 0), ('unanswerable_with_gold', 0), ('grade', 0), ('one_hop', 0)) t(rule, n)""")
def persona_problems(spark: SparkSession, d: str) -> DataFrame:
    return external.benchmark_problems(*external.personas(spark, _file(spark, [_PERSONA])), personas_wanted=1, each_type=2)


_CASES = [("1", "My favorite book is Dune.", "preference"), ("2", "Buy groceries today.", "task"), ("3", "Thank you!", "temporary"), ("4", "First run tests, then deploy the application.", "semantic")]


@query("""SELECT label, support::BIGINT AS support, "precision", recall FROM (VALUES ('preference', 1, 1.0::DOUBLE, 1.0::DOUBLE), ('task', 1, 1.0, 1.0), ('temporary', 1, 1.0, 1.0), ('semantic', 1, 0.0, 0.0), ('procedural', 0, 0.0, 0.0)) t(label, support, "precision", recall)""")
def classification_cases(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark, [{"id": i, "content": c, "expected_category": k, "expected_tier": "working", "importance_range": [0.0, 1.0]} for i, c, k in _CASES])
    return evaluate.classification(external.labelled_cases(spark, path), at(NOW))[0].select("label", "support", "precision", "recall")


@query("SELECT memory, importance_score FROM (VALUES ('a, b', 0.5::DOUBLE), ('c', 0.25)) t(memory, importance_score)")
def training_source(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark)}/file-{uuid.uuid4().hex}"
    spark.createDataFrame([("a, b", 0.5), ("c", 0.25)], "memory string, importance_score double").coalesce(1).write.option("header", True).csv(path)
    return external.training_rows(spark, path)


@query("SELECT key, value FROM (VALUES ('hit', 0.5::DOUBLE), ('mrr', 0.25)) t(key, value)")
def report_source(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark)}/file-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps({"flat": {"hit": 0.5, "mrr": 0.25, "protocol.k": 5, "name": "x"}}),)], "value string").coalesce(1).write.text(path)
    return external.reports(spark, f"{path}/*.txt").select("key", "value")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id % 2 = 0")
def versioned_table(spark: SparkSession, d: str) -> DataFrame:
    """A table written anew twice: readers see the newest whole version."""
    root = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    log.replace(docs, root)
    log.replace(docs.filter("doc_id % 2 = 0"), root)
    return log.current_version(spark, root)


def _log_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log: ids of users, some columns of a revision."""
    e = table(spark, d, "events")
    t, none = F.col("ts"), F.lit(None).cast("timestamp_ntz")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("user_id"), F.col("event_type").alias("session_id"), F.lit("user").alias("role"), F.col("event_type").alias("content"), F.when(F.col("event_id") % 2 == 0, "semantic").otherwise("episodic").alias("category"),
        F.when(F.col("event_id") % 3 == 0, "long_term").otherwise("short_term").alias("tier"), t.alias("created_at"), t.alias("updated_at"), F.when(F.col("event_id") % 5 == 0, t + F.make_dt_interval(days=F.lit(3))).alias("expires_at"), none.alias("last_accessed_at"), none.alias("last_observed_at"), none.alias("archive_after"),
        F.lit(0.5).alias("confidence"), F.lit(0.5).alias("importance_score"), F.lit(0).alias("access_count"), F.when(F.col("event_id") % 7 == 0, "superseded").otherwise("active").alias("memory_status"), F.lit(None).cast("string").alias("task_status"),
    )


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 AND ts <= TIMESTAMP '2024-04-10' - INTERVAL 90 DAY THEN 'archive' WHEN event_id % 3 = 0 THEN 'long_term' ELSE 'short_term' END AS tier FROM events
WHERE user_id = 7 AND (event_id % 5 <> 0 OR ts + INTERVAL 3 DAY > TIMESTAMP '2024-04-10') AND event_id % 7 <> 0 ORDER BY ts DESC, event_id LIMIT 20""")
def store_list(spark: SparkSession, d: str) -> DataFrame:
    return log.listed(_log_rows(spark, d), at("2024-04-10"), 20, user="u7").select("id", "tier")


@query("""SELECT event_id AS id FROM events WHERE event_type = 'signup' AND user_id = 7 AND event_id % 2 = 0 ORDER BY pow(2, -epoch(TIMESTAMP '2024-04-10' - ts) / 86400 / 30) * 0.1 + 0.05 * CASE WHEN event_id % 3 = 0 AND ts <= TIMESTAMP '2024-04-10' - INTERVAL 90 DAY THEN 0.2 WHEN event_id % 3 = 0 THEN 1 ELSE 0.7 END DESC, ts DESC, event_id LIMIT 10""")
def store_search(spark: SparkSession, d: str) -> DataFrame:
    return log.searched(_log_rows(spark, d), "Signup page", at("2024-04-10"), 10, user="u7", category="semantic", expired=True, history=True).select("id")


@query("""SELECT event_id AS id, 'u' || user_id AS user_id, event_type AS session_id, 0.5::DOUBLE AS confidence, ts AS created_at FROM events WHERE user_id = 7""")
def user_export(spark: SparkSession, d: str) -> DataFrame:
    return log.exported(_log_rows(spark, d), "u7").select("id", "user_id", "session_id", F.col("confidence").cast("double").alias("confidence"), "created_at")


@query("SELECT id, problem FROM (VALUES ('a', 'blank'), ('b', 'confidence'), ('c', 'owner')) t(id, problem)")
def append_problems(spark: SparkSession, d: str) -> DataFrame:
    rows = [("a", "u", "s", " ", 0.5), ("b", "u", "s", "x", 1.5), ("c", "u", "s", "x", 0.5), ("d", "u", "s", "x", 1.0)]
    known = spark.createDataFrame([("c", "v"), ("d", "u")], "id string, user_id string")
    return log.problems(spark.createDataFrame(rows, "id string, user_id string, session_id string, content string, confidence double"), known)


_INTENTS = ("Which city does Jonas live in right now?", "After the schedule change, which day is the retro?", "Which day did Amara first say her lab meeting happened?", "Where did Jonas spend Easter in 2024?", "What are my plans in 2027?", "Which exam did Jonas register to take?", "What did I originally plan, and what is it now?")


@query("SELECT id::BIGINT AS id, intent FROM (VALUES (0, 'current'), (1, 'current'), (2, 'history'), (3, 'history'), (4, 'neutral'), (5, 'neutral'), (6, 'neutral')) t(id, intent)")
def time_intents(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_INTENTS)), "id bigint, t string").select("id", rules.time_intent(F.col("t"), 2026).alias("intent"))


_CUED = ("Which city is my home?", "Where does Ann work, and who is her manager?", "Do I like nuts, or am I allergic?", "What is due?", "Who owned the project?", "Hello")


@query("SELECT id::BIGINT AS id, cues FROM (VALUES (0, 'lives_in'), (1, 'based_in,reports_to,works_at'), (2, 'allergic_to,likes'), (3, 'due_at,has_task,task_status'), (4, 'depends_on,owned_by,works_on'), (5, '')) t(id, cues)")
def predicate_cues(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_CUED)), "id bigint, t string").select("id", F.array_join(F.array_sort(graph.cued(F.col("t"))), ",").alias("cues"))


_RULED = ("if it rains", 'the "red" one is mine', "never include nuts", "I'd rather walk", "the report has already been submitted", "I haven't paid", "We use Spark", "Thanks a lot!", "Type I diabetes", "What's my dog's name again?", "Can you tell me about Spain?", "I moved last week")
_NAMES = ("uncertain", "constraint", "completed", "negated", "fact", "phatic", "own")
_TRUE = {0: "uncertain", 1: "uncertain", 2: "constraint", 3: "constraint own", 4: "", 5: "negated own", 6: "fact own", 7: "phatic", 8: "", 9: "uncertain", 10: "uncertain", 11: "own"}


@query("SELECT id::BIGINT AS id, met FROM (VALUES " + ", ".join(f"({i}, '{m}')" for i, m in _TRUE.items()) + ") t(id, met)")
def predicates_golden(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    met = (rules.uncertain(t), rules.constraint(t), rules.completed(t), rules.negated_task(t), rules.durable_fact(t), rules.phatic(t), rules.self_disclosure(t))
    return spark.createDataFrame(list(enumerate(_RULED)), "id bigint, t string").select("id", F.array_join(F.array_compact(F.array(*[F.when(m, n) for n, m in zip(_NAMES, met, strict=True)])), " ").alias("met"))


@query("""SELECT doc_id, contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), ' ') || ' ', ' all rights reserved ') AS holds FROM documents""".replace("\\\\", "\\"))
def phrase_containment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rules.contains_phrase(F.col("text"), F.lit("All rights reserved")).alias("holds"))


@query("""SELECT id::BIGINT AS id, problem FROM (VALUES (0, NULL), (1, 'entity'), (2, 'entity'), (3, 'alias'), (4, 'relation'), (5, 'interval'), (6, 'relation')) t(id, problem)""")
def graph_metadata_golden(spark: SparkSession, d: str) -> DataFrame:
    one = {"id": "a", "type": "person", "label": "Ann", "aliases": ["Annie"]}
    said = {"subject": "self", "predicate": "knows", "object": "a"}
    cases = [([one], [said]), ([{**one, "type": "robot"}], []), ([one, one], []), ([{**one, "aliases": [" "]}], []), ([one], [{**said, "object": "b"}]), ([one], [{**said, "valid_from": "2026-02-01T00:00:00", "valid_to": "2026-01-01T00:00:00"}]), ([one], [{**said, "predicate": "Knows Of"}])]
    rows = spark.createDataFrame([(i, json.dumps(e), json.dumps(r)) for i, (e, r) in enumerate(cases)], "id bigint, e string, r string")
    return rows.select("id", graph_build.metadata_problem(F.from_json("e", graph_build._ENTITY), F.from_json("r", graph_build._RELATION), at(NOW)).alias("problem"))


@query("""SELECT red, form, said, topic FROM (VALUES ('{"a":["[REDACTED_EMAIL]",{"note":"call [REDACTED_PHONE]"}],"n":5}', 'the cat', '2023-05-20 10:00', 'flat,rent')) t(red, form, said, topic)""")
def value_functions(spark: SparkSession, d: str) -> DataFrame:
    one = spark.createDataFrame([('{"a":["ann@example.org",{"note":"call +1 555 123 4567"}],"n":5}', "The cat (example 12)", "2023/05/20 (Sat) 10:00", "What is the rent of my flat now?")], "j string, s string, t string, q string")
    return one.select(values.redacted_json(F.col("j")).alias("red"), values.sentence_form(F.col("s")).alias("form"), F.date_format(values.time_of(F.col("t")), "yyyy-MM-dd HH:mm").alias("said"), F.array_join(F.array_sort(search.topics(F.col("q"))), ",").alias("topic"))


@query("SELECT place, n FROM (VALUES ('one', 3), ('two', 3)) t(place, n)")
def document_texts(spark: SparkSession, d: str) -> DataFrame:
    """Candidate texts: at most three different ones for each record, the found one first."""
    q = spark.createDataFrame([(1, "red fox")], "query_id bigint, text string")
    chunks = spark.createDataFrame([(i, k, t) for i in (1, 2) for k, t in ((0, "a fox"), (100, "a red fox"), (200, "none"), (300, "a fox"), (400, "red"))], "id bigint, start int, text string")
    texts = search.candidate_texts(spark.createDataFrame([(1, 1), (1, 2)], "query_id bigint, id bigint"), q, chunks)
    right = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "|") == "a red fox|a fox|red"
    return texts.groupBy("id").agg(F.count("*").cast("int").alias("n"), right.alias("ok")).filter("ok").select(F.when(F.col("id") == 1, "one").otherwise("two").alias("place"), "n")


@query("SELECT role, n::BIGINT AS n, visible FROM (VALUES ('user', 3, 0.666667::DOUBLE), ('assistant', 1, 0.0)) t(role, n, visible)")
def retention_replay(spark: SparkSession, d: str) -> DataFrame:
    """What a replay of a history still shows after 20 days."""
    said = [(1, "user", "My name is Ann."), (2, "user", "I bought a bike yesterday"), (3, "user", "Thanks!"), (4, "assistant", "You are welcome")]
    m = spark.createDataFrame(said, "id bigint, role string, content string").withColumns({"user_id": F.lit("u"), "session_id": F.lit("s"), "created_at": at(NOW)})
    return evaluate.replayed(m, at("2026-10-16 12:00:00"))


@query("SELECT arm, n::BIGINT AS n FROM (VALUES ('keyword', 2), ('full', 2)) t(arm, n)")
def arms_golden(spark: SparkSession, d: str) -> DataFrame:
    """Two arms over two questions, with a result for each."""
    r = spark.createDataFrame([(1, "I live in Rome"), (2, "The fox is red"), (3, "Rome is old")], "id bigint, content string").withColumns({"user_id": F.lit("u"), "created_at": at(NOW), "category": F.lit("semantic"), "tier": F.lit("long_term"), "importance": F.lit(0.5)})
    q = spark.createDataFrame([(1, "Where is Rome?"), (2, "Which fox?")], "query_id bigint, text string").withColumn("user_id", F.lit("u"))
    rel = spark.createDataFrame([(1, 1, 3), (2, 2, 1)], "query_id bigint, id bigint, grade int")
    arms = tuple(a for a in evaluate.ARMS if a.name in ("keyword", "full"))
    return evaluate.run_arms(q, r, rel, at(NOW), 3, scorer=search.overlap_scorer, arms=arms).filter("hit = 1").groupBy("arm").agg(F.count("*").alias("n"))

