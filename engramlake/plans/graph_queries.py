"""Queries over graphs made of the star schema, and over vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.operators import graph, retention, vectors
from engramlake.plans.registry import at, query, table

AT = "1996-06-01"
_ORDER_EDGES = """SELECT o_orderkey AS id, o_custkey AS subject, o_orderpriority AS object, o_orderdate AS valid_from,
 lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders"""
_NEXT = "lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


def order_edges(spark: SparkSession, d: str) -> DataFrame:
    """An edge from each customer to an order's priority, valid until the customer's next order, known three days later."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("object"), F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_to"), "o_orderstatus")
    later = lambda c: F.col(c) + F.make_dt_interval(days=F.lit(3))
    return e.withColumns({"known_from": later("valid_from"), "known_to": later("valid_to"), "predicate": F.lit("priority"), "positive": F.lit(True), "source_id": F.col("id")})


@query(f"""SELECT id, subject, object FROM ({_ORDER_EDGES}) WHERE valid_from <= TIMESTAMP '1996-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-06-01')
AND valid_from + INTERVAL 3 DAY <= TIMESTAMP '1996-06-02' AND (valid_to IS NULL OR valid_to + INTERVAL 3 DAY > TIMESTAMP '1996-06-02')""")
def bitemporal_asof(spark: SparkSession, d: str) -> DataFrame:
    known = F.lit("1996-06-02 00:00:00").cast("timestamp_ntz")
    return graph.as_of(order_edges(spark, d), at(AT), known).select("id", "subject", "object")


@query("""SELECT c.c_custkey AS id, n.n_name AS subject_label, r.r_name AS object_label FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def edge_labels(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("label")).union(r.select(F.concat(F.lit("r"), "r_regionkey"), "r_name"))
    home = n.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    edges = table(spark, d, "customer").join(home, "c_nationkey").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("subject"), F.concat(F.lit("r"), "n_regionkey").alias("object"))
    return graph.labelled(edges, nodes).select("id", "subject_label", "object_label")


@query("""WITH t AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), ' ') || ' ' AS w FROM documents),
a(node_id, alias) AS (VALUES (1, 'all rights reserved'), (2, 'MIT License'), (3, 'Apache License'), (4, 'GNU General Public License'), (5, 'the'))
SELECT doc_id, node_id, alias FROM t JOIN a ON contains(w, ' ' || lower(alias) || ' ')""")
def entity_match(spark: SparkSession, d: str) -> DataFrame:
    names = [(1, "all rights reserved"), (2, "MIT License"), (3, "Apache License"), (4, "GNU General Public License"), (5, "the")]
    return graph.mentions(table(spark, d, "documents"), spark.createDataFrame(names, "node_id int, alias string"), "doc_id", "text")


_GRAPH = """SELECT 'c' || c_custkey AS s, 'n' || c_nationkey AS o FROM customer WHERE c_custkey <= 60 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders WHERE o_custkey <= 60 UNION ALL SELECT 'r' || r_regionkey, 'n' || (r_regionkey * 2) FROM region"""


def star_edges(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda t, a, x, b, y: table(spark, d, t).select(F.concat(F.lit(a), x).alias("subject"), F.concat(F.lit(b), y).alias("object"))
    e = pair("customer", "c", "c_custkey", "n", "c_nationkey").unionByName(pair("nation", "n", "n_nationkey", "r", "n_regionkey")).unionByName(pair("orders", "o", "o_orderkey", "c", "o_custkey"))
    back = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("subject"), F.concat(F.lit("n"), (F.col("r_regionkey") * 2).cast("string")).alias("object"))
    return e.unionByName(back).withColumns({"positive": F.lit(True), "id": F.concat("subject", F.lit(">"), "object")})


@query(f"""WITH RECURSIVE e AS ({_GRAPH.replace('WHERE c_custkey <= 60', '').replace('WHERE o_custkey <= 60', '')}), p AS (SELECT 'o' || o_orderkey AS seed, 'o' || o_orderkey AS node, 0 AS hop, ['o' || o_orderkey] AS nodes FROM orders
UNION ALL SELECT p.seed, e.o, p.hop + 1, list_append(p.nodes, e.o) FROM p JOIN e ON p.node = e.s WHERE p.hop < 4 AND NOT list_contains(p.nodes, e.o))
SELECT seed, node, hop, array_to_string(nodes, '>') AS path FROM p WHERE hop > 0""")
def traverse_paths(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return graph.paths(star_edges(spark, d), seeds, 4).select("seed", "node", "hop", F.array_join("nodes", ">").alias("path"))


@query(f"""WITH e AS (SELECT o_orderkey AS id, o_custkey AS subject, o_orderdate AS valid_from, {_NEXT} AS valid_to FROM orders),
p AS (SELECT a.id AS stale_id, b.id AS next_id, abs(epoch(b.valid_from) - epoch(a.valid_to))::BIGINT AS gap_seconds FROM e a JOIN e b ON a.subject = b.subject AND a.id <> b.id AND b.valid_from >= a.valid_from
WHERE a.valid_to <= TIMESTAMP '1996-06-01' AND b.valid_from <= TIMESTAMP '1996-06-01' AND (b.valid_to IS NULL OR b.valid_to > TIMESTAMP '1996-06-01'))
SELECT * FROM p QUALIFY rank() OVER (PARTITION BY stale_id ORDER BY gap_seconds) = 1""")
def stale_successor(spark: SparkSession, d: str) -> DataFrame:
    return graph.successors(order_edges(spark, d), at(AT))


@query(f"""SELECT subject AS source_id, bool_and(coalesce(valid_to <= TIMESTAMP '1996-06-01', false)) AS stale, count(*) AS n_edges FROM ({_ORDER_EDGES}) GROUP BY 1""")
def stale_sources(spark: SparkSession, d: str) -> DataFrame:
    return graph.stale_sources(order_edges(spark, d).withColumn("source_id", F.col("subject")), at(AT))


_LINKS = "SELECT 'o' || l_orderkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"


def references(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda t, a, x, b, y: table(spark, d, t).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    return pair("lineitem", "o", "l_orderkey", "s", "l_suppkey").union(pair("supplier", "s", "s_suppkey", "n", "s_nationkey")).union(pair("nation", "n", "n_nationkey", "r", "n_regionkey"))


@query(f"""WITH RECURSIVE l AS ({_LINKS}), t(id) AS (SELECT 'o' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT dst FROM t JOIN l ON t.id = l.src) SELECT id FROM t""")
def reference_closure(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    return graph.reachable(references(spark, d), roots)


@query(f"""WITH RECURSIVE r AS (SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1997-01-01' OR o_orderstatus = 'O' THEN 'keep'
WHEN o_orderpriority = '1-URGENT' THEN 'hold' WHEN o_totalprice >= 200000 THEN 'archive' ELSE 'eligible' END AS first FROM orders
UNION ALL SELECT 's' || s_suppkey, 'eligible' FROM supplier), l AS ({_LINKS}),
t(id) AS (SELECT id FROM r WHERE first <> 'eligible' UNION SELECT dst FROM t JOIN l ON t.id = l.src)
SELECT r.id, CASE WHEN first <> 'eligible' THEN first WHEN t.id IS NOT NULL THEN 'keep' ELSE 'remove' END AS action FROM r LEFT JOIN t ON r.id = t.id""")
def cleanup_plan(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("id"), (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(90))).alias("expires_at"),
        (F.col("o_orderpriority") == "1-URGENT").alias("held"), (F.col("o_totalprice") >= 200000).alias("durable"), (F.col("o_orderstatus") == "O").alias("open_task"),
    )
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), at("1990-01-01").alias("expires_at"), *[F.lit(False).alias(c) for c in ("held", "durable", "open_task")])
    return retention.plan(o.unionByName(s), references(spark, d), at("1997-01-01"))


def _queries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return base.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), base


_PAIRS = """SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id"""


@query(f"SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_PAIRS})) WHERE rank <= 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.top_k(*_queries(spark, d), 10)


@query(f"SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_PAIRS}) WHERE score >= 0.35) WHERE rank <= 50")
def vector_min_similarity(spark: SparkSession, d: str) -> DataFrame:
    return vectors.top_k(*_queries(spark, d), 50, least=0.35)


@query()
def lsh_topk(spark: SparkSession, d: str) -> DataFrame:
    q, base = _queries(spark, d)
    one = base.first()
    return vectors.lsh_top_k(q, base, 10, vectors.Planes(len(one["vector"]) if one else 1, tables=16), radius=2)


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'insert' WHEN a.doc_id IS NULL THEN 'delete' ELSE 'update' END AS action FROM
(SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0) a FULL OUTER JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN md5('old') ELSE md5(text) END AS h FROM documents WHERE doc_id % 11 <> 0) b
ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.h <> b.h""")
def index_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    wanted = docs.filter("doc_id % 7 <> 0")
    existing = docs.filter("doc_id % 11 <> 0").withColumn("h", F.when(F.col("doc_id") % 5 == 0, F.md5(F.lit("old"))).otherwise(F.col("h")))
    return vectors.index_difference(wanted, existing, "doc_id", "h")
