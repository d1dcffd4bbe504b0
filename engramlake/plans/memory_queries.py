"""Stated messages through whole operators: ingest, graph, search, answers; each beside the outcome that it should have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.engine import Engine
from engramlake.functions import answers, claims
from engramlake.operators import graph, graph_build, ingest, retention, search
from engramlake.plans.registry import at, query
from engramlake.session import stored

NOW = "2026-09-26 12:00:00"
LATER = "2026-09-23 12:00:00"  # after the last message of the diary

_MESSAGES = (
    "My favorite book is Dune.", "Never include peanuts in my meals.", "The meeting has been cancelled.", "I have already submitted my report today.", "Buy groceries today.", "Remind me to take a walk every day.", "My name is Matthew.",
    "First run tests, then deploy the application.", "Thank you!", "I am responsible for the Atlas migration.", "I moved to Bengaluru", "Do you know that I am moving house?", "What is the capital of Peru?", "Call me at +91 98765 43210 or write to ann@example.org", "",
)


@query("""SELECT id::BIGINT AS id, category, tier, has_claim, problem, expires::TIMESTAMP AS expires FROM (VALUES (1, 'preference', 'long_term', true, NULL, NULL), (2, 'preference', 'long_term', false, NULL, NULL), (3, 'episodic', 'short_term', false, NULL, '2026-10-10 12:00:00'),
(4, 'episodic', 'short_term', false, NULL, '2026-12-25 12:00:00'), (5, 'task', 'short_term', false, NULL, '2026-09-27 23:59:59'), (6, 'task', 'long_term', false, NULL, NULL), (7, 'semantic', 'long_term', true, NULL, NULL), (8, 'procedural', 'long_term', false, NULL, NULL),
(9, 'temporary', 'working', false, NULL, '2026-09-26 13:00:00'), (10, 'semantic', 'long_term', false, NULL, NULL), (11, 'semantic', 'long_term', true, NULL, NULL), (12, 'episodic', 'short_term', false, NULL, '2026-12-25 12:00:00'), (13, 'temporary', 'working', false, NULL, '2026-09-26 13:00:00'),
(14, 'task', 'short_term', false, NULL, '2026-10-10 12:00:00'), (15, 'temporary', 'working', false, 'blank', '2026-09-26 13:00:00')) t(id, category, tier, has_claim, problem, expires)""")
def process_golden(spark: SparkSession, d: str) -> DataFrame:
    m = spark.createDataFrame([(i, "u", "s", t) for i, t in enumerate(_MESSAGES, 1)], "id bigint, user_id string, session_id string, content string").withColumn("created_at", at(NOW))
    r = ingest.process(m, at(NOW))
    return r.select("id", "category", "tier", F.col("claim").isNotNull().alias("has_claim"), "problem", F.col("expires_at").alias("expires"))


@query("""SELECT v, k, place FROM (VALUES (6, 3, 'chennai'), (6, 9, 'bengaluru'), (3, 9, 'chennai'), (1, 1, NULL), (11, 11, 'chennai'), (6, 11, 'bengaluru')) t(v, k, place)""")
def graph_golden(spark: SparkSession, d: str) -> DataFrame:
    """Where someone lived on a day, by what was known on another: a move, told late, and taken back by hand."""
    day = lambda n: f"2026-01-{n:02d} 00:00:00"
    log = [  # id, position, text, status, created, updated, recorded, confirmed, decided
        ("a", 1, "I live in Chennai.", "active", 1, 1, 2, None, None), ("a", 2, "I live in Chennai.", "superseded", 1, 5, 8, None, 5), ("b", 3, "I live in Bengaluru.", "active", 5, 5, 8, None, None),
        ("b", 4, "I live in Bengaluru.", "superseded", 5, 10, 10, None, 10), ("a", 5, "I live in Chennai.", "active", 1, 10, 10, 10, None),
    ]
    rows = [("u", i, p, "user", "semantic", t, s, *[n and day(n) for n in ns]) for i, p, t, s, *ns in log]
    r = spark.createDataFrame(rows, "user_id string, id string, position int, role string, category string, content string, memory_status string, created_at string, updated_at string, recorded_at string, last_confirmed_at string, decided_at string")
    r = r.withColumns({c: F.col(c).cast("timestamp_ntz") for c in r.columns if c.endswith("_at")}).withColumn("claims", claims.claims_of(F.col("content"))["all"])
    nodes, _, edges = graph_build.build(stored(r))
    homes = edges.join(nodes.select("user_id", F.col("id").alias("object"), "label"), ["user_id", "object"]).filter("predicate = 'lives_in'")
    asked = spark.createDataFrame([(6, 3), (6, 9), (3, 9), (1, 1), (11, 11), (6, 11)], "v int, k int")
    moment = lambda c: F.make_timestamp_ntz(F.lit(2026), F.lit(1), F.col(c), F.lit(0), F.lit(0), F.lit(0))
    q = asked.withColumns({"_v": moment("v"), "_k": moment("k")})
    held = (F.col("valid_from") <= F.col("_v")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("_v"))) & (F.col("known_from") <= F.col("_k")) & (F.col("known_to").isNull() | (F.col("known_to") > F.col("_k")))
    return q.join(homes, held, "left").select("v", "k", F.lower("label").alias("place"))


_ENTITY = "array<struct<id: string, type: string, label: string, aliases: array<string>>>"
_RELATION = "array<struct<subject: string, predicate: string, object: string, positive: boolean, valid_from: timestamp_ntz, valid_to: timestamp_ntz>>"
_STATED = "id bigint, content string, created string, speaker string, entities string, relations string, user_id string"


def _stated(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Records with their entities and relations as JSON, as a log of one revision each."""
    r = spark.createDataFrame(rows, _STATED).withColumn("created_at", F.col("created").cast("timestamp_ntz"))
    r = r.withColumns({"entities": F.from_json("entities", _ENTITY), "relations": F.from_json("relations", _RELATION), "role": F.lit("user"), "category": F.lit("semantic"), "tier": F.lit("long_term")})
    r = r.withColumns({"importance": F.lit(0.8), "memory_status": F.lit("active"), "position": F.col("id"), "updated_at": F.col("created_at"), "recorded_at": F.col("created_at")})
    return stored(r.withColumn("claims", claims.claims_of(F.col("content"))["all"]).drop("created"))


def _scripted(script: dict[str, float]) -> search.Scorer:
    """A reranker that scores a text by the first phrase of a script that it holds."""

    def score(question, text):
        out = F.lit(-5.0)
        for phrase, value in reversed(script.items()):
            out = F.when(F.contains(text, F.lit(phrase)), F.lit(value)).otherwise(out)
        return out

    return score


_LISBON, _PORTO = '{"id":"loc:lisbon","type":"location","label":"Lisbon"}', '{"id":"loc:porto","type":"location","label":"Porto"}'
_HOMES = [
    (1, "I have been renting a flat in Lisbon since 2021", "2024-01-01", None, f"[{_LISBON}]", '[{"subject":"self","predicate":"lives_in","object":"loc:lisbon","valid_from":"2021-04-01T00:00:00","valid_to":"2025-03-15T00:00:00"}]'),
    (2, "We finally moved to Porto last March", "2025-06-01", None, f"[{_PORTO}]", '[{"subject":"self","predicate":"lives_in","object":"loc:porto","valid_from":"2025-03-15T00:00:00"}]'),
    (3, "I have a flat white every morning", "2024-02-01", None, None, None),
]
_TIDE, _ROT = '{"id":"org:tidewater","type":"organization","label":"Tidewater Labs"}', '{"id":"loc:rotterdam","type":"location","label":"Rotterdam"}'
_JOBS = [
    (4, "Starting in June I joined Tidewater Labs as a senior analyst", "2025-06-01", None, f"[{_TIDE}]", '[{"subject":"self","predicate":"works_at","object":"org:tidewater"}]'),
    (5, "Tidewater Labs is headquartered in Rotterdam", "2025-06-01", None, f"[{_TIDE},{_ROT}]", '[{"subject":"org:tidewater","predicate":"based_in","object":"loc:rotterdam"}]'),
    (6, "Their old office headquarters were noisy", "2024-01-01", None, None, None),
]
_RETROS = [(7, "Our team retro happens on Fridays at 4pm", "2024-01-01", "Priya", None, None), (8, "Correction: the retro moved to Thursdays at 3", "2024-05-01", "Priya", None, None), (9, "Our retro is on Mondays", "2024-06-01", "Jonas", None, None)]
_SCRIPT = {"Lisbon": 5.0, "flat white": 4.0, "Porto": -6.0, "Rotterdam": 4.0, "headquarters": 4.5, "senior analyst": -9.0, "Fridays": 7.0, "Thursdays": 6.0, "Mondays": 1.0}


_UNSURE = [(10, "A flat in Lisbon was mine", "2024-01-01", None, f"[{_LISBON}]", '[{"subject":"self","predicate":"lives_in","object":"loc:lisbon","valid_to":"2025-01-01T00:00:00"}]'), (11, "Moved on to Porto", "2025-01-01", None, f"[{_PORTO}]", '[{"subject":"self","predicate":"lives_in","object":"loc:porto"}]')]
_QUESTIONS = [  # id, user, question
    (1, "homes", "Which city do I live in?"), (2, "homes", "How much rent did I pay for my flat in Lisbon?"), (3, "homes", "Which town was I in before, in my flat?"), (4, "jobs", "In which city is the company I work for headquartered?"),
    (5, "retros", "Which day is Priya's retro on now?"), (6, "retros", "Which day was Priya's retro on originally?"), (7, "retros", "Which day is Priya's retro on?"), (8, "unsure", "Which city was it, with a flat?"), (9, "unsure", "  "),
]


@query("""SELECT query_id::BIGINT AS query_id, id::BIGINT AS id, rank, notes, status FROM (VALUES (1, 2, 1, 'supersedes:1', 'applied'), (1, 1, 2, '', 'applied'), (1, 3, 3, '', 'applied'), (2, 1, 1, '', 'applied'), (2, 3, 2, '', 'applied'), (3, 1, 1, '', 'applied'), (3, 3, 2, '', 'applied'),
(4, 5, 1, 'graph_path', 'applied'), (4, 4, 2, 'chain_partner_of:5', 'applied'), (5, 8, 1, 'newer_version_of:7', 'applied'), (5, 7, 2, '', 'applied'), (5, 9, 3, '', 'applied'), (6, 7, 1, '', 'applied'), (6, 8, 2, '', 'applied'), (6, 9, 3, '', 'applied'),
(7, 7, 1, '', 'applied'), (7, 8, 2, '', 'applied'), (7, 9, 3, '', 'applied'), (8, 10, 1, '', 'fallback')) t(query_id, id, rank, notes, status)""")
def hybrid_search_golden(spark: SparkSession, d: str) -> DataFrame:
    """Questions of four users over their own records. A statement that no longer holds gives its place to the one that followed
    it, if the question asks for that relation; what lies on a path that the question hints at comes first, with its partner
    behind it; asked for now, the newer of two statements of one speaker comes first; where a score is not a number the fused
    order stands, and nothing enters that no channel found."""
    of = {"homes": _HOMES, "jobs": _JOBS, "retros": _RETROS, "unsure": _UNSURE}
    r = _stated(spark, [(*row, user) for user, rows in of.items() for row in rows])
    asked = spark.createDataFrame(_QUESTIONS, "query_id bigint, user_id string, text string")
    script = {"A flat in Lisbon was": float("nan"), **_SCRIPT}
    hits = search.hybrid(asked, r, at(NOW), 3, graph=tuple(map(stored, graph_build.build(r))), scorer=_scripted(script), steps=(*search.STEPS, "versions"))
    return hits.select("query_id", "id", "rank", F.array_join("notes", ",").alias("notes"), "status")


_TEAM = [(11, "Alice reports to Bob", "2026-01-01", None, None, None), (12, "Bob works on Atlas", "2026-01-02", None, None, None), (13, "Atlas is owned by Acme", "2026-01-03", None, None, None), (14, "Carol knows Alice", "2026-01-04", None, None, None)]


@query("""SELECT hop, nodes, sources FROM (VALUES (1, 'Alice>Bob', '11'), (2, 'Alice>Bob>Atlas', '11,12'), (1, 'Alice>Carol', '14')) t(hop, nodes, sources)""")
def graph_paths_golden(spark: SparkSession, d: str) -> DataFrame:
    """Paths from a person over claims: a project that someone works on and one that is owned are nodes of one kind and name."""
    nodes, aliases, edges = graph_build.build(_stated(spark, [(*row, "u") for row in _TEAM]))
    label = nodes.select("id", "label")
    seed = label.filter("label = 'Alice'").select(F.col("id").alias("node"))
    found = graph.paths(edges, seed, 2, "both", 100)
    named = found.select("hop", "edges", F.posexplode("nodes").alias("i", "id")).join(label, "id").groupBy("hop", "edges").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "label"))), lambda x: x["label"]), ">").alias("nodes"))
    steps = named.select("hop", "nodes", F.posexplode("edges").alias("i", "id")).join(edges.select("id", "source_id"), "id")
    return steps.groupBy("hop", "nodes").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "source_id"))), lambda x: x["source_id"].cast("string")), ",").alias("sources"))


_DIARY = [
    (1, "ann", "I live in Chennai.", "2026-09-01 10:00:00"), (2, "ann", "I live in Bengaluru.", "2026-09-10 10:00:00"), (3, "ann", "I reside in Bengaluru.", "2026-09-12 10:00:00"), (4, "ann", "Remind me to water the plants every day at 8 pm", "2026-09-20 09:00:00"),
    (5, "ann", "I watered nothing", "2026-09-20 10:00:00"), (6, "bob", "My favorite book is Dune.", "2026-09-21 10:00:00"), (7, "bob", "Pay the phone bill", "2026-09-22 10:00:00"), (8, "bob", "I paid the phone bill", "2026-09-23 10:00:00"), (6, "bob", "My favorite book is Dune.", "2026-09-21 10:00:00"),
    (9, "bob", "  ", "2026-09-21 10:00:00"), (10, "ann", "Thanks!", "2026-09-21 10:00:00"),
]


def _engine(spark: SparkSession) -> Engine:
    m = spark.createDataFrame(_DIARY, "id bigint, user_id string, content string, at string").withColumns({"session_id": F.lit("s"), "created_at": F.col("at").cast("timestamp_ntz")}).drop("at")
    e = Engine(spark, scorer=search.overlap_scorer)
    e.ingest(m, at(LATER))
    return e


@query("""SELECT id::BIGINT AS id, user_id, category, memory_status, into_id::BIGINT AS into_id, task_status FROM (VALUES (1, 'ann', 'semantic', 'superseded', 2, NULL), (2, 'ann', 'semantic', 'active', NULL, NULL), (3, 'ann', 'semantic', 'consolidated', 2, NULL), (4, 'ann', 'task', 'active', NULL, 'active'),
(5, 'ann', 'episodic', 'active', NULL, NULL), (6, 'bob', 'preference', 'active', NULL, NULL), (7, 'bob', 'task', 'active', NULL, 'completed'), (8, 'bob', 'episodic', 'active', NULL, NULL), (10, 'ann', 'temporary', 'active', NULL, NULL)) t(id, user_id, category, memory_status, into_id, task_status)""")
def ingest_golden(spark: SparkSession, d: str) -> DataFrame:
    """Messages of two users through the whole of it: a move, a repeat, a task that is done, one message that comes twice and one that is blank."""
    done = _engine(spark).log.withColumns({c: F.col(c).cast("bigint") for c in ("id", "superseded_by", "consolidated_into")})
    return done.select("id", "user_id", "category", "memory_status", F.coalesce("superseded_by", "consolidated_into").alias("into_id"), "task_status")


@query("""SELECT kind, id::BIGINT AS id FROM (VALUES ('list', 2), ('list', 4), ('search', 2), ('answer', 2), ('graph', 2), ('view', 9), ('cleanup', 5), ('cleanup', 10)) t(kind, id)""")
def engine_golden(spark: SparkSession, d: str) -> DataFrame:
    """The verbs on that log: what one user's list shows, a search in it, an answer, an edge, a view, and what a cleanup would remove."""
    e, now = _engine(spark), at(LATER)
    said, _ = e.ask(spark.createDataFrame([(1, "ann", "Where do I live, in which city?")], "query_id bigint, user_id string, text string"), now)
    home = e.graph(now, predicate="lives_in").select(F.col("source_id").alias("id"))
    e.views(now)
    parts = {
        "list": e.list(now, user="ann").select("id"), "search": e.search("Bengaluru", now, user="ann").select("id"), "answer": said.orderBy("query_id").filter(F.contains("text", F.lit("Bengaluru"))).select(F.col("source_id").alias("id")), "graph": home,
        "view": spark.sql("SELECT count(*) AS id FROM revisions"), "cleanup": e.cleanup("ann", now, grace_days=0)["actions"].filter("action = 'remove'").select("id"),
    }
    out = None
    for kind, rows in parts.items():
        rows = rows.select(F.lit(kind).alias("kind"), F.col("id").cast("bigint").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


_KEPT = [  # id, position, user, category, status, expires, importance, hold, evidence
    ("a", 1, "u", "temporary", None, "2026-09-01", 0.1, False, []), ("b", 2, "u", "temporary", None, "2026-09-01", 0.1, False, []), ("c", 3, "u", "semantic", None, "2026-09-01", 0.1, False, []), ("d", 4, "u", "temporary", None, "2026-09-01", 0.7, False, []),
    ("e", 5, "u", "temporary", None, "2026-09-01", 0.1, True, []), ("f", 6, "u", "task", "active", "2026-09-01", 0.1, False, []), ("g", 7, "v", "temporary", None, None, 0.1, False, ["b"]), ("h", 8, "u", "temporary", None, "2026-09-25", 0.1, False, []),
    ("i", 9, "u", "task", "completed", "2026-09-01", 0.1, False, ["j"]), ("j", 10, "u", "temporary", None, "2026-09-01", 0.1, False, ["i"]), ("h", 11, "u", "temporary", None, "2026-09-25", 0.1, False, []), ("e", 12, "u", "temporary", None, "2026-09-01", 0.1, False, []),
]


@query("""SELECT id, action, n_left::BIGINT AS n_left FROM (VALUES ('a', 'remove', 0), ('b', 'keep', 1), ('c', 'archive', 1), ('d', 'archive', 1), ('e', 'hold', 2), ('f', 'keep', 1), ('h', 'keep', 1), ('i', 'remove', 0), ('j', 'remove', 0)) t(id, action, n_left)""")
def cleanup_golden(spark: SparkSession, d: str) -> DataFrame:
    """What goes and what stays: holds of any revision, archives, open tasks, a reference from another user, a cycle that nothing else needs, and repeats."""
    r = spark.createDataFrame(_KEPT, "id string, position int, user_id string, category string, task_status string, expires string, importance double, legal_hold boolean, evidence_ids array<string>")
    r = stored(r.withColumn("expires_at", F.col("expires").cast("timestamp_ntz")).drop("expires"))
    out = retention.cleanup(r, "u", at(NOW), apply=True)
    left = out["log"].groupBy("id").agg(F.count("*").alias("n"))
    return out["actions"].join(left, "id", "left").select("id", "action", F.coalesce("n", F.lit(0)).alias("n_left"))


_EVIDENCE = [(1, "I pay 900 euros for the flat every month.", 3.0), (2, "The flat has two rooms.", 1.0), (3, "Priya's brother Arjun works as a nurse.", 2.0), (4, "We met in spring.", -3.0), (5, "Biscuit ran for two hours.", 0.5)]


@query("""SELECT query_id::BIGINT AS query_id, slot, reason FROM (VALUES (1, 'money', NULL), (2, 'money', 'unfilled_money_slot'), (3, 'occupation', NULL), (4, NULL, NULL), (5, 'duration', NULL), (6, 'frequency', 'unfilled_frequency_slot'), (7, NULL, 'low_reranker_confidence')) t(query_id, slot, reason)""")
def abstention_golden(spark: SparkSession, d: str) -> DataFrame:
    asked = [(1, "How much is the rent of my flat, how much do I pay?"), (2, "How much did the car cost?"), (3, "What does Priya's brother do for a living?"), (4, "Is my dog called Biscuit?"), (5, "How long did Biscuit run?"), (6, "How often does Priya swim?"), (7, "Did we meet?")]
    q = spark.createDataFrame(asked, "query_id bigint, text string")
    only = {1: (1, 2), 2: (2,), 3: (3,), 4: (5,), 5: (5,), 6: (3, 2), 7: (4,)}
    s = spark.createDataFrame([(i, k, t, x) for i, ks in only.items() for k, t, x in _EVIDENCE if k in ks], "query_id bigint, source_id bigint, text string, score double")
    return answers.abstentions(q, s, 0.2)
