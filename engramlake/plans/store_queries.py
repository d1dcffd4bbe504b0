"""Stored structures over the given tables: the committed log, tables in parts, the approximate index, classes of contradictions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.engine import Engine
from engramlake.operators import ann, graph, reconcile
from engramlake.plans.graph_queries import star_edges
from engramlake.plans.registry import at, query, table
from engramlake.session import shared_folder
from engramlake.sources.commits import CommitLog
from engramlake.sources.parts import Keyed
from engramlake.streaming import ingest


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as records: their ids are strings, and some fifty users have all of them."""
    t = table(spark, d, "conversations")
    return t.select(
        F.concat_ws("#", "conv_id", "turn").alias("id"), F.concat(F.lit("u"), F.col("conv_id") % 50).alias("user_id"), F.col("conv_id").cast("string").alias("session_id"),
        "role", F.col("text").alias("content"), "turn",
    )


def _logged(spark: SparkSession, d: str) -> CommitLog:
    """Three commits: even turns, odd turns, and the first turns again with a mark."""
    t = _turns(spark, d)
    log = CommitLog(spark, _folder(spark, "commits"), buckets=8)
    log.append(t.filter("turn % 2 = 0"))
    log.append(t.filter("turn % 2 = 1").withColumn("late", F.lit(True)))
    log.append(t.filter("turn = 0").withColumn("content", F.concat("content", F.lit("!"))))
    return log


@query("""SELECT conv_id || '#' || turn AS id, 'u' || (conv_id % 50) AS user_id, CASE WHEN turn = 0 THEN md5(text || '!') ELSE md5(text) END AS digest, CASE WHEN turn % 2 = 1 THEN true END AS late FROM conversations""")
def commit_log_current(spark: SparkSession, d: str) -> DataFrame:
    """The last revision of each record of a log whose second commit added a column."""
    return _logged(spark, d).current().select("id", "user_id", F.md5("content").alias("digest"), "late")


@query("""SELECT id, (row_number() OVER (PARTITION BY id ORDER BY c))::INTEGER AS revision, c::BIGINT AS number, digest FROM (
SELECT conv_id || '#' || turn AS id, conv_id, 1 + turn % 2 AS c, md5(text) AS digest FROM conversations UNION ALL SELECT conv_id || '#0', conv_id, 3, md5(text || '!') FROM conversations WHERE turn = 0) WHERE conv_id % 50 < 10""")
def commit_log_users(spark: SparkSession, d: str) -> DataFrame:
    """All revisions of ten users in log order; the folders of other users are not opened."""
    log = _logged(spark, d)
    users = spark.range(10).select(F.concat(F.lit("u"), "id").alias("user_id"))
    w = F.row_number().over(graph.Window.partitionBy("id").orderBy("log_pos"))
    return log.revisions(users=users).select("id", w.alias("revision"), F.shiftright("log_pos", 32).alias("number"), F.md5("content").alias("digest"))


@query("SELECT user_id AS key, max(event_id) AS version, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 4) AS value FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def table_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user, from batches that come in the wrong order, one of them twice; users whose last event is an error are deleted."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), "event_type", F.round("value", 4).alias("value"), (F.col("event_type") == "error").alias("deleted"))
    kept = Keyed(spark, _folder(spark, "keyed"), parts=8)
    for batch, part in enumerate((2, 0, 1)):
        kept.merge(e.filter(F.col("version") % 3 == part), batch)
    kept.merge(e.filter(F.col("version") % 3 == 0), 1)
    return kept.rows().select("key", "version", "event_type", "value")


@query("SELECT user_id AS key, max(event_id) AS version, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """As ``table_upkeep``, by a stream."""
    events = ingest.read_events(spark, f"{d}/{{events}}.parquet", table(spark, d, "events").schema)
    changes = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), "event_type")
    kept = Keyed(spark, _folder(spark, "keyed"), parts=8)
    ingest.refreshed(changes, kept, _folder(spark, "progress")).awaitTermination()
    return kept.rows().select("key", "version", "event_type")


@query()
def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best of every 20th vector by the stored index, whatever the size of the table; recall is tested."""
    v = table(spark, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("id"), "vec_id", ann.unit_of("embedding").alias("vector"))
    index = ann.VectorIndex(spark, _folder(spark, "vectors"))
    index.sync(v.select("id", "vector"))
    return index.search(v.filter("vec_id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), 10, exact_rows=0)


_STATED = """SELECT user_id, event_type AS subject, 'k' || (event_id % 40) AS predicate, event_id AS id, round_even(value, 0)::INTEGER % 3 AS value, event_id % 2 = 0 AS positive, event_id % 3 <> 0 AS exclusive FROM events"""


@query(f"""WITH c AS (SELECT user_id, subject, predicate, value, positive, exclusive, min(id) AS class_id, count(*) AS n FROM ({_STATED}) GROUP BY ALL)
SELECT a.user_id, a.subject, a.predicate, a.class_id AS left_class, b.class_id AS right_class, a.n * b.n AS n_pairs FROM c a JOIN c b USING (user_id, subject, predicate)
WHERE a.class_id < b.class_id AND ((a.value = b.value AND a.positive <> b.positive) OR (a.exclusive AND b.exclusive AND a.positive AND b.positive AND a.value <> b.value))""")
def contradiction_classes(spark: SparkSession, d: str) -> DataFrame:
    """What contradicts what among the statements of events, as links of classes."""
    i = F.col("event_id")
    c = table(spark, d, "events").select(
        "user_id", F.col("event_type").alias("subject"), F.concat(F.lit("k"), (i % 40).cast("string")).alias("predicate"), i.alias("id"),
        (F.rint("value").cast("int") % 3).alias("value"), (i % 2 == 0).alias("positive"), (i % 3 != 0).alias("exclusive"),
    )
    return reconcile.contradiction_classes(c)[2]


@query("""WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS s, 'n' || c_nationkey AS o FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders
UNION ALL SELECT 'r' || r_regionkey, 'n' || (r_regionkey * 2) FROM region),
p AS (SELECT o_custkey % 20 AS grp, 'o' || o_orderkey AS seed, 'o' || o_orderkey AS node, 0 AS hop, ['o' || o_orderkey] AS nodes, []::VARCHAR[] AS edges FROM orders
UNION ALL SELECT p.grp, p.seed, e.o, p.hop + 1, list_append(p.nodes, e.o), list_append(p.edges, e.s || '>' || e.o) FROM p JOIN e ON p.node = e.s WHERE p.hop < 3 AND NOT list_contains(p.nodes, e.o))
SELECT grp, seed, node, hop FROM p WHERE hop > 0 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY hop, edges, seed) <= 100""")
def grouped_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths from many orders, of which the first hundred of each group of customers count, over all its orders together."""
    seeds = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("group"), F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return graph.paths(star_edges(spark, d), seeds, 3, most=100).select(F.col("group").alias("grp"), "seed", "node", "hop")


@query("""SELECT user_id, count(*) AS n_messages, count(*) FILTER (turn > 0) AS n_second, true AS settled FROM (SELECT 'u' || (conv_id % 50) AS user_id, turn FROM conversations WHERE role = 'user' AND trim(text) <> '') GROUP BY 1""")
def engine_conversations(spark: SparkSession, d: str) -> DataFrame:
    """What users say in conversations, taken in by the engine in two batches: how many of each user's messages have records, and since
    which commit; ``settled``: every record of theirs is active, or joined or gave way to one that exists."""
    t = _turns(spark, d).filter("role = 'user'").withColumn("created_at", F.make_timestamp_ntz(F.lit(2026), F.lit(9), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(mins=F.col("turn").cast("int")))
    e, now = Engine(spark), at("2026-09-26 12:00:00")
    e.ingest(t.filter("turn = 0").drop("turn"), now)
    e.ingest(t.filter("turn > 0").drop("turn"), now)
    log = e.log
    first = e.revisions().groupBy("id").agg(F.min(F.shiftright("log_pos", 32)).alias("number"))
    known = log.select(F.col("id").alias("_known"))
    other = log.withColumn("_other", F.coalesce("superseded_by", "consolidated_into")).join(known, F.col("_other") == F.col("_known"), "left")
    each = other.join(first, "id").withColumns({"message": F.concat_ws("#", F.split("id", "#")[0], F.split("id", "#")[1]), "fine": (F.col("memory_status") == "active") | F.col("_known").isNotNull()})
    return each.groupBy("user_id").agg(F.count_distinct("message").alias("n_messages"), F.count_distinct(F.when(F.col("number") == 2, F.col("message"))).alias("n_second"), F.bool_and("fine").alias("settled"))
