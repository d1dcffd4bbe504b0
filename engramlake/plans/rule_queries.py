"""Text rules on stated sentences, beside the outcome that each of them should have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.functions import answers, claims, rules, schedule, tasks
from engramlake.operators import ingest, reconcile, task_updates
from engramlake.plans.registry import at, query, table
from engramlake.session import stored

NOW = "2026-09-26 12:00:00"  # a Saturday, in a zone 330 minutes ahead of UTC


def _said(spark: SparkSession, texts: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts, 1)), "id bigint, text string")


_DEADLINES = (
    "Submit the report tomorrow at 5 pm", "Buy groceries today", "Submit the report next Monday by 09:30", "Pay rent by 2026-11-01", "Submit by 2026-10-01T17:00:00Z",
    "Send the report in 2 hours", "Not tomorrow", "Today or tomorrow", "Do this sometime soon", "Pay by 2026-02-30", "Call tomorrow at 25:00", "Call tomorrow at 13 pm", "Clean up next saturday", "In 99999999999 weeks",
)


@query("""SELECT id::BIGINT AS id, due::TIMESTAMP AS due, problem FROM (VALUES (1, '2026-09-27 17:00:00', NULL), (2, '2026-09-26 23:59:59', NULL), (3, '2026-09-28 09:30:00', NULL), (4, '2026-11-01 23:59:59', NULL),
(5, '2026-10-01 22:30:00', NULL), (6, '2026-09-26 14:00:00', NULL), (7, NULL, NULL), (8, NULL, NULL), (9, NULL, NULL), (10, NULL, 'date'), (11, NULL, 'hour'), (12, NULL, 'hour'), (13, '2026-10-03 23:59:59', NULL), (14, NULL, 'range')) t(id, due, problem)""")
def deadline_golden(spark: SparkSession, d: str) -> DataFrame:
    return _said(spark, _DEADLINES).select("id", schedule.deadline(F.col("text"), at(NOW), F.lit(330)).alias("x")).select("id", "x.*")


_SCHEDULES = (
    "Remind me to submit the report daily at 5 pm", "Remind me every 2 weeks", "Water the plants every other day", "Call mum every monday at 9 am", "Pay rent monthly starting 2026-09-30",
    "Remind me every 0 days", "Run every day and every week", "Swim every day except sunday", "Buy milk", "Stretch daily at 8 am",
)


@query("""SELECT id::BIGINT AS id, unit, "interval", anchor::TIMESTAMP AS anchor, problem FROM (VALUES (1, 'day', 1, '2026-09-26 17:00:00', NULL), (2, 'week', 2, '2026-09-26 23:59:59', NULL), (3, 'day', 2, '2026-09-26 23:59:59', NULL),
(4, 'week', 1, '2026-09-28 09:00:00', NULL), (5, 'month', 1, '2026-09-30 23:59:59', NULL), (6, NULL, NULL, NULL, 'interval'), (7, NULL, NULL, NULL, NULL), (8, NULL, NULL, NULL, NULL), (9, NULL, NULL, NULL, NULL),
(10, 'day', 1, '2026-09-27 08:00:00', NULL)) t(id, unit, "interval", anchor, problem)""")
def recurrence_golden(spark: SparkSession, d: str) -> DataFrame:
    return _said(spark, _SCHEDULES).select("id", schedule.recurrence(F.col("text"), at(NOW)).alias("x")).select("id", "x.*")


@query("""SELECT unit, "index", due::TIMESTAMP AS due FROM (VALUES ('month', 1, '2026-02-28 10:00:00'), ('month', 2, '2026-03-31 10:00:00'), ('month', 3, '2026-04-30 10:00:00'), ('year', 1, '2025-02-28 23:59:59'),
('year', 4, '2028-02-29 23:59:59'), ('week', 1, '2026-10-10 12:00:00')) t(unit, "index", due)""")
def recurrence_schedule(spark: SparkSession, d: str) -> DataFrame:
    asked = [("month", 1, "2026-01-31 10:00:00", i) for i in (1, 2, 3)] + [("year", 1, "2024-02-29 23:59:59", i) for i in (1, 4)] + [("week", 2, NOW, 1)]
    rows = spark.createDataFrame(asked, "unit string, every int, anchor string, index int")
    return rows.select("unit", "index", schedule.occurrence(F.col("unit"), F.col("every"), F.col("anchor").cast("timestamp_ntz"), F.col("index")).alias("due"))


_MESSAGES = (
    "I prefer Python, and remind me to call Alex tomorrow.", "I like apples and oranges.", "If it rains, buy a coat and send it.", "Buy milk; pay rent\nI am tired", 'The sign said "stop; my friend" here', "I don't know. My name is O'Neil, but the rest isn't.",
)


@query(r"""SELECT id::BIGINT AS id, segment_index, segment_count, text, (TIMESTAMP '2026-09-26 12:00:00' + segment_index * INTERVAL 1 MICROSECOND) AS ts FROM (VALUES (1, 0, 2, 'I prefer Python'), (1, 1, 2, 'remind me to call Alex tomorrow.'),
(2, 0, 1, 'I like apples and oranges.'), (3, 0, 1, 'If it rains, buy a coat and send it.'), (4, 0, 3, 'Buy milk'), (4, 1, 3, 'pay rent'), (4, 2, 3, 'I am tired'), (5, 0, 1, 'The sign said "stop; my friend" here'),
(6, 0, 3, 'I don''t know.'), (6, 1, 3, 'My name is O''Neil'), (6, 2, 3, 'the rest isn''t.')) t(id, segment_index, segment_count, text)""")
def segment_golden(spark: SparkSession, d: str) -> DataFrame:
    return tasks.with_clauses(_said(spark, _MESSAGES).withColumn("ts", at(NOW)), "text", "ts").select("id", "segment_index", "segment_count", "text", "ts")


_ACTIONS = (
    "I submitted the report.", "The meeting was called off", "Please reschedule the dentist from monday to 2026-10-05", "Postpone the review by 2 days", "The report is not due monday, but friday", "I haven't sent the invoice",
    "Stop reminding me to stretch", "Cancel the gym permanently", "Did I pay rent?", "The deadline for the essay is now 2026-10-09", "We're done with the audit!", "I paid rent and sent the invoice", "My flight was moved to friday", "Good morning",
)


@query("""SELECT id::BIGINT AS id, kind, reference, due_text, scope FROM (VALUES (1, 'completed', 'the report', '', NULL), (2, 'cancelled', 'meeting', '', NULL), (3, 'rescheduled', 'the dentist', '2026-10-05', NULL), (4, 'rescheduled', 'the review', 'delay 2 days', NULL),
(5, 'rescheduled', 'report', 'friday', NULL), (6, NULL, NULL, NULL, NULL), (7, 'cancelled', 'stretch', '', 'series'), (8, 'cancelled', 'the gym', '', 'series'), (9, NULL, NULL, NULL, NULL), (10, 'rescheduled', 'the essay', '2026-10-09', NULL),
(11, 'completed', 'the audit', '', NULL), (12, NULL, NULL, NULL, NULL), (13, 'rescheduled', 'flight', 'friday', NULL), (14, NULL, NULL, NULL, NULL)) t(id, kind, reference, due_text, scope)""")
def tasks_golden(spark: SparkSession, d: str) -> DataFrame:
    return _said(spark, _ACTIONS).select("id", tasks.action(F.col("text")).alias("x")).select("id", "x.*")


@query("""SELECT id::BIGINT AS id, key, tier FROM (VALUES (1, 'quarterly report', 1), (2, 'report', 2), (3, '2 report', 0), (4, 'invoice', 0)) t(id, key, tier)""")
def task_reference(spark: SparkSession, d: str) -> DataFrame:
    known = _said(spark, ("Submit the quarterly report by 5 pm", "Send the report tomorrow", "Finish report 2 in 3 days", "Pay the invoice on 2026-10-01"))
    own = tasks.key(F.col("text"))
    return known.select("id", F.array_join(own, " ").alias("key"), tasks.refers(own, tasks.key(F.lit("the report"))).alias("tier"))


_SENTENCES = ("My favorite book is Dune.", "Never include peanuts in my meals.", "The meeting has been cancelled.", "I have already submitted my report today.", "Buy groceries today.", "Remind me to take a walk every day.", "My name is Matthew.", "First run tests, then deploy the application.", "Thank you!", "I am responsible for the Atlas migration.")


def _category(text: Column) -> Column:
    of = lambda c: rules.category(text, c["one"], c["all"], tasks.action(F.lower(text)), rules.self_disclosure(text))
    return rules.given(claims.claims_of(text), of)


_ASSERTED = (
    "I recently moved to New Delhi", "I moved to the backend team", "I no longer live in Chennai.", "I work as a data engineer", "I now work at Initech, now", "My home city is Porto", "My time zone is UTC", "My dog's name is Rex.", "Alice lives in Paris",
    "My favourite colour is blue!", "I prefer brief answers", "I can't stand long explanations", "I prefer tea over coffee", "I don't like mushrooms", "I'm not allergic to nuts", "Alice reports to Bob", "My manager is Dana", "Atlas is owned by Acme Corp.",
    "They work on Atlas", "I like apples and pears", "Do I live in Rome?", "I used to live in Oslo, but now I live in Bergen.", "I'd rather have tea", "I live in Rome because of work", "Actually, I reside in ＲＯＭＥ", "Bob knows Carol", "I like tea. My name is Ann; I work for Acme",
)


@query("""SELECT id::BIGINT AS id, subject, predicate, value, positive, exclusive, kind, told, n::INT AS n FROM (VALUES
(1, 'self', 'residence', 'new delhi', true, true, 'semantic', 'User lives in New Delhi.', 1), (2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0), (3, 'self', 'residence', 'chennai', false, true, 'semantic', 'User does not live in Chennai.', 1),
(4, 'self', 'occupation', 'a data engineer', true, true, 'semantic', 'User''s occupation is a data engineer.', 1), (5, 'self', 'employer', 'initech', true, true, 'semantic', 'User works at Initech.', 1), (6, 'self', 'residence', 'porto', true, true, 'semantic', 'User lives in Porto.', 1),
(7, 'self', 'timezone', 'utc', true, true, 'semantic', 'User''s timezone is UTC.', 1), (8, 'my:dog', 'name', 'rex', true, true, 'semantic', 'My dog''s name is Rex.', 1), (9, 'entity:alice', 'residence', 'paris', true, true, 'semantic', 'Alice lives in Paris.', 1),
(10, 'self', 'favorite:colour', 'blue', true, true, 'preference', 'User''s favorite colour is blue.', 1), (11, 'self', 'response_length', 'concise', true, true, 'preference', 'User prefers concise responses.', 1),
(12, 'self', 'response_length', 'detailed', false, true, 'preference', 'User does not prefer detailed responses.', 1), (13, 'self', 'choice:coffee|tea', 'tea', true, true, 'preference', 'User prefers tea over coffee.', 1),
(14, 'self', 'taste', 'mushrooms', false, false, 'preference', 'User does not like mushrooms.', 1), (15, 'self', 'allergy', 'nuts', false, false, 'preference', 'User is not allergic to nuts.', 1), (16, 'entity:alice', 'manager', 'bob', true, true, 'semantic', 'Alice reports to Bob.', 1),
(17, 'self', 'manager', 'dana', true, true, 'semantic', 'User reports to Dana.', 1), (18, 'project:atlas', 'owned_by', 'acme corp', true, true, 'semantic', 'Atlas is owned by Acme Corp.', 1), (19, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0), (20, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0),
(21, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0), (22, 'self', 'residence', 'bergen', true, true, 'semantic', 'User lives in Bergen.', 1), (23, 'self', 'taste', 'tea', true, false, 'preference', 'User likes tea.', 1), (24, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0),
(25, 'self', 'residence', 'rome', true, true, 'semantic', 'User lives in ＲＯＭＥ.', 1), (26, 'entity:bob', 'knows', 'carol', true, false, 'semantic', 'Bob knows Carol.', 1), (27, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 3)) t(id, subject, predicate, value, positive, exclusive, kind, told, n)""")
def claims_golden(spark: SparkSession, d: str) -> DataFrame:
    found = _said(spark, _ASSERTED).select("id", claims.claims_of(F.col("text")).alias("c"))
    one = F.col("c.one")
    return found.select("id", *[one[k].alias(k) for k in ("subject", "predicate", "value", "positive", "exclusive", "kind")], F.when(one.isNotNull(), claims.summary(one)).alias("told"), F.size("c.all").alias("n"))


@query("""SELECT id::BIGINT AS id, category FROM (VALUES (1, 'preference'), (2, 'preference'), (3, 'episodic'), (4, 'episodic'), (5, 'task'), (6, 'task'), (7, 'semantic'), (8, 'procedural'), (9, 'temporary'), (10, 'semantic')) t(id, category)""")
def classify_golden(spark: SparkSession, d: str) -> DataFrame:
    return _said(spark, _SENTENCES).select("id", _category(F.col("text")).alias("category"))


_QUESTIONS = (
    "What does Priya's brother do for a living?", "Do you know what job Amara's brother in Arusha has?", "What is the name of my cat?", "Do you know what Priya's sister is called?", "What did Priya name her rescue dog?", "Which city does Priya live in?",
    "How often does Priya swim?", "How much did the new bike cost?", "What annual salary does Ravi earn?", "How long does Priya knead the dough?", "How many hours does Jonas cure the salmon?", "How far is the forest loop?", "Is my dog called Biscuit?",
    "What is the name of the dog called Biscuit?", "What is John's number one goal in his basketball career?", "How much do I like jazz?", "How many days ago did I watch the Super Bowl?", "How many plants did I acquire in the last month?",
)


@query("""SELECT id::BIGINT AS id, slot FROM (VALUES (1, 'occupation'), (2, 'occupation'), (3, 'name'), (4, 'name'), (5, 'name'), (6, 'entity'), (7, 'frequency'), (8, 'money'), (9, 'money'), (10, 'duration'), (11, 'duration'), (12, 'distance'),
(13, NULL), (14, NULL), (15, NULL), (16, NULL), (17, NULL), (18, NULL)) t(id, slot)""")
def slot_golden(spark: SparkSession, d: str) -> DataFrame:
    return _said(spark, _QUESTIONS).select("id", answers.slot(F.col("text")).alias("slot"))


@query("""SELECT word, stem FROM (VALUES ('Cities', 'city'), ('boxes', 'box'), ('dogs', 'dog'), ('glass', 'glass'), ('running', 'run'), ('planned', 'plan'), ('Priya''s', 'priya'), ('bake', 'bak'), ('baking', 'bak'), ('was', 'was'), ('sing', 'sing')) t(word, stem)""")
def stem_golden(spark: SparkSession, d: str) -> DataFrame:
    words = ("Cities", "boxes", "dogs", "glass", "running", "planned", "Priya's", "bake", "baking", "was", "sing")
    return _said(spark, words).select(F.col("text").alias("word"), answers.stem(F.col("text")).alias("stem"))


@query("""SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s) <> '')) AS n FROM documents WHERE text IS NOT NULL""".replace("\\\\", "\\"))
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.size(answers.sentences(F.col("text"))).alias("n"))


@query("""SELECT query_id::BIGINT AS query_id, source_id::BIGINT AS source_id, quote, problem FROM (VALUES (1, 11, 'in Rome', 'quote'), (1, 12, 'I live', 'source'), (2, 21, '', 'quote')) t(query_id, source_id, quote, problem)""")
def unsupported_statements(spark: SparkSession, d: str) -> DataFrame:
    said = spark.createDataFrame([(1, 11, "live in Lisbon"), (1, 11, "in Rome"), (1, 12, "I live"), (2, 21, ""), (2, 21, "Rex")], "query_id bigint, source_id bigint, quote string")
    found = spark.createDataFrame([(1, 11, "I live in Lisbon."), (2, 21, "My dog is Rex."), (2, 12, "I live in Porto.")], "query_id bigint, source_id bigint, text string")
    return answers.unsupported(said, found)


_OBSERVED = [  # user, id, seconds, content, source_priority, confidence, importance
    ("time", 1, 0, "I live in Chennai.", 0, 0.5, 0.5), ("time", 2, 60, "I live in Bengaluru.", 0, 0.5, 0.5), ("priority", 3, 0, "I live in Chennai.", 90, 0.5, 0.5), ("priority", 4, 60, "I live in Mumbai.", 10, 0.5, 0.5),
    ("confidence", 5, 0, "I live in Chennai.", 0, 0.9, 0.5), ("confidence", 6, 60, "I live in Mumbai.", 0, 0.2, 0.5), ("importance", 7, 0, "I live in Chennai.", 0, 0.5, 0.8), ("importance", 8, 0, "I live in Mumbai.", 0, 0.5, 0.6),
    ("importance", 9, 0, "I live in Delhi.", 0, 0.5, 0.8), ("same", 10, 0, "I live in Chennai.", 0, 0.5, 0.5), ("same", 11, 60, "I reside in Chennai.", 0, 0.5, 0.5), ("moved", 12, 0, "I live in Chennai.", 0, 0.5, 0.5), ("moved", 13, 60, "I recently relocated to New Delhi.", 0, 0.5, 0.5),
    ("team", 14, 0, "I live in Chennai.", 0, 0.5, 0.5), ("team", 15, 60, "I moved to the backend team", 0, 0.5, 0.5), ("home", 16, 0, "My home city is Oslo.", 0, 0.5, 0.5), ("home", 17, 60, "I live in Bergen.", 0, 0.5, 0.5),
    ("text", 18, 0, "Always use the blue template for invoices", 0, 0.5, 0.5), ("text", 19, 60, "Always use a blue template for the invoices", 0, 0.5, 0.5), ("text", 20, 90, "Never use the red template", 0, 0.5, 0.5),
]


_RECORD = "id bigint, user_id string, session_id string, content string, seconds int, source_priority double, confidence double, importance double"


def _records(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Records of messages, with the importance that is given."""
    m = spark.createDataFrame(rows, _RECORD).withColumn("created_at", at(NOW) + F.make_dt_interval(secs=F.col("seconds")))
    return stored(ingest.process(m.withColumnRenamed("importance", "given"), at(NOW)).withColumn("importance", F.col("given")))


@query("""SELECT id::BIGINT AS id, status, superseded_by::BIGINT AS superseded_by, consolidated_into::BIGINT AS consolidated_into, reason FROM (VALUES (1, 'superseded', 2, NULL, 'observation_time'), (3, 'active', NULL, NULL, 'source_priority'), (4, 'superseded', 3, NULL, 'source_priority'),
(5, 'active', NULL, NULL, 'confidence'), (6, 'superseded', 5, NULL, 'confidence'), (7, 'active', NULL, NULL, 'tie_kept_existing'), (8, 'superseded', 7, NULL, 'importance'), (9, 'superseded', 7, NULL, 'tie_kept_existing'), (10, 'active', NULL, NULL, NULL), (11, 'consolidated', NULL, 10, NULL),
(12, 'superseded', 13, NULL, 'observation_time'), (2, 'active', NULL, NULL, 'observation_time'), (13, 'active', NULL, NULL, 'observation_time'), (14, 'active', NULL, NULL, NULL), (15, 'active', NULL, NULL, NULL), (16, 'superseded', 17, NULL, 'observation_time'),
(17, 'active', NULL, NULL, 'observation_time'), (18, 'active', NULL, NULL, NULL), (19, 'consolidated', NULL, 18, NULL), (20, 'active', NULL, NULL, NULL)) t(id, status, superseded_by, consolidated_into, reason)""")
def reconcile_golden(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, u, "s", t, s, float(p), c, w) for u, i, s, t, p, c, w in _OBSERVED]
    return reconcile.reconciled(_records(spark, rows)).select("id", "status", "superseded_by", "consolidated_into", "reason")


@query("""SELECT id::BIGINT AS id, evidence, sessions, summary FROM (VALUES (10, '10,11', 's1,s2', 'User lives in Chennai.'), (18, '18,19', 's1', 'Always use the blue template for invoices Related observations: Always use a blue template for the invoices'), (20, '20', 's1', NULL)) t(id, evidence, sessions, summary)""")
def evidence_golden(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, u, "s2" if i == 11 else "s1", t, s, float(p), c, w) for u, i, s, t, p, c, w in _OBSERVED if i in (10, 11, 18, 19, 20)]
    r = _records(spark, rows)
    found = reconcile.evidence(r, reconcile.reconciled(r))
    return found.select("id", F.array_join("evidence_ids", ",").alias("evidence"), F.array_join("evidence_session_ids", ",").alias("sessions"), "summary")


@query("""SELECT id::BIGINT AS id, status, superseded_by::BIGINT AS superseded_by, reason FROM (VALUES (1, 'active', NULL, 'explicit_selection'), (2, 'superseded', 1, 'explicit_selection')) t(id, status, superseded_by, reason)""")
def selection_golden(spark: SparkSession, d: str) -> DataFrame:
    """The first of two homes is chosen by hand after the second had replaced it."""
    rows = [(i, u, "s1", t, s, float(p), c, w) for u, i, s, t, p, c, w in _OBSERVED if i in (1, 2, 10)]
    r = _records(spark, rows)
    now = r.join(reconcile.reconciled(r).select("id", F.col("status").alias("memory_status")), "id").withColumn("updated_at", F.col("created_at"))
    return reconcile.selected(now, F.col("id") == 1, at("2026-09-27 00:00:00")).select("id", "status", "superseded_by", "reason")


@query("""SELECT id::BIGINT AS id, evidence_id::BIGINT AS evidence_id, problem FROM (VALUES (1, 10, 'owner'), (1, 99, 'missing'), (1, 2, 'assertion')) t(id, evidence_id, problem)""")
def evidence_problems(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, u, "s1", t, s, float(p), c, w) for u, i, s, t, p, c, w in _OBSERVED if i in (1, 2, 10)]
    r = _records(spark, rows).withColumn("evidence_ids", F.when(F.col("id") == 1, F.array(*[F.lit(x).cast("bigint") for x in (1, 2, 10, 99)])).otherwise(F.array("id")))
    return reconcile.unsupported_evidence(r)


_TOLD = (  # id, user, session, minutes after NOW, text, due_at, task_scope, occurrence_on
    (1, "ann", "s1", 0, "Remind me to submit the report daily at 5 pm", None, None, None), (2, "ann", "s1", 10, "I submitted the report", None, None, None), (3, "ann", "s1", 20, "I submitted the report", None, None, "2026-09-26"), (4, "ann", "s1", 30, "I submitted the report", None, None, None),
    (5, "bob", "s2", 0, "Pay rent monthly", "2026-09-30 09:00:00", None, None), (6, "bob", "s2", 10, "Skip rent", None, None, None), (7, "bob", "s2", 20, "Move rent to 2026-12-15", None, None, None),
    (8, "cy", "s3", 0, "Send the invoice weekly", "2026-09-28 09:00:00", None, None), (9, "cy", "s3", 10, "Move the invoice to 2026-09-29 at 10:00", None, None, None), (10, "cy", "s3", 4000, "I sent the invoice", None, None, None),
    (11, "dee", "s4", 0, "Buy groceries today", None, None, None), (12, "dee", "s4", 5, "Postpone groceries by 2 days", None, None, None), (13, "dee", "s4", 6, "I bought the groceries", None, None, None), (14, "dee", "s4", 7, "I bought the groceries", None, None, None),
    (15, "eve", "s5", 0, "Pay the phone bill", None, None, None), (16, "eve", "s5", 0, "Pay the water bill", None, None, None), (17, "eve", "s5", 9, "I paid the bill", None, None, None), (18, "eve", "s5", 9, "Postpone the water bill", None, None, None), (19, "eve", "s5", -5, "I paid the phone bill", None, None, None),
    (20, "bob", "s2", 30, "Move rent to 2026-10-01", None, "series", None), (21, "ann", "s1", 40, "Stop reminding me to submit the report", None, None, None), (22, "ann", "s1", 50, "Cancel the report on 2027-01-01", None, None, None),
)


def _tasks(spark: SparkSession) -> DataFrame:
    m = spark.createDataFrame(list(_TOLD), "id bigint, user_id string, session_id string, minutes int, content string, due_at string, task_scope string, occurrence_on string")
    m = m.withColumns({"created_at": at(NOW) + F.make_dt_interval(mins=F.col("minutes")), "due_at": F.col("due_at").cast("timestamp_ntz")})
    return stored(ingest.process(m, at(NOW)))


@query("""SELECT id::BIGINT AS id, resolution, task_id::BIGINT AS task_id, status, due::TIMESTAMP AS due, n FROM (VALUES (2, 'applied', 1, 'active', '2026-09-27 17:00:00', 1), (3, 'already_resolved', NULL, NULL, NULL, NULL), (4, 'occurrence_required', NULL, NULL, NULL, NULL),
(6, 'applied', 5, 'active', '2026-10-30 09:00:00', 1), (7, 'occurrence_overlaps_next', NULL, NULL, NULL, NULL), (9, 'applied', 8, 'active', '2026-09-29 10:00:00', 0), (10, 'applied', 8, 'active', '2026-10-05 09:00:00', 1), (12, 'applied', 11, 'active', '2026-09-28 23:59:59', 0),
(13, 'applied', 11, 'completed', '2026-09-28 23:59:59', 0), (14, 'unmatched', NULL, NULL, NULL, NULL), (17, 'ambiguous', NULL, NULL, NULL, NULL), (18, 'missing_deadline', NULL, NULL, NULL, NULL), (19, 'unmatched', NULL, NULL, NULL, NULL), (20, 'applied', 5, 'active', '2026-10-01 23:59:59', 1),
(21, 'applied', 1, 'cancelled', NULL, 1), (22, 'unmatched', NULL, NULL, NULL, NULL)) t(id, resolution, task_id, status, due, n)""")
def task_revision_golden(spark: SparkSession, d: str) -> DataFrame:
    found = task_updates.revised(_tasks(spark))
    return found.select("id", "resolution", "task_id", F.col("task_status").alias("status"), F.coalesce("next_due_at", "due_at").alias("due"), F.col("n_occurrences").alias("n"))


@query("""SELECT event_id::BIGINT AS event_id, resolution, task_id::BIGINT AS task_id FROM (VALUES (1, 'applied', 11), (2, 'applied', 10), (3, 'ambiguous', NULL), (4, 'unmatched', NULL), (5, 'applied', 14), (6, 'unmatched', NULL), (7, 'ambiguous', NULL)) t(event_id, resolution, task_id)""")
def task_resolution(spark: SparkSession, d: str) -> DataFrame:
    known = [(10, "ann", "s1", 0, "Submit the quarterly report"), (11, "ann", "s1", 0, "Send the report tomorrow"), (12, "ann", "s2", 0, "Pay the rent"), (13, "ann", "s2", 0, "Pay rent for the garage"), (14, "bob", "s3", 0, "Call the dentist"), (15, "bob", "s4", 90, "Finish essay 2"), (16, "cy", "s5", 0, "Pay rent flat"), (17, "cy", "s5", 0, "Pay rent garage")]
    said = [(1, "ann", "s1", 10, "the report"), (2, "ann", "s1", 10, "quarterly report"), (3, "ann", "s2", 10, "it"), (4, "ann", "s1", 10, "essay"), (5, "bob", "s3", 10, "that"), (6, "bob", "s4", 10, "essay 2"), (7, "cy", "s6", 10, "rent")]
    moment = lambda c: at(NOW) + F.make_dt_interval(secs=F.col(c))
    tasks_ = spark.createDataFrame(known, "task_id bigint, user_id string, session_id string, s int, content string").withColumn("updated_at", moment("s"))
    events = spark.createDataFrame(said, "event_id bigint, user_id string, session_id string, s int, reference string").withColumn("at", moment("s"))
    return task_updates.matched(events, tasks_).select("event_id", "resolution", "task_id")
