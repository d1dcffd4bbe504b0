"""How text filters overlap: what each one removes alone, after others, and over all orders.

1. A document becomes one number, its mask: bit ``k`` is set where it fails filter ``k``. Copies are
   found by the SHA-256 of the text: a small table holds the least doc_id of every text that occurs
   more than once, and the rows of a text that a third of the documents share are dealt to many
   tasks by the join with it.
2. Documents are counted by part and mask, before and after the shuffle. These cells are all that
   remains, at most 32 for each part, whatever the number of documents.
3. The masks (32) are unpivoted against the steps of all orders (120 x 5). A running bit-or over the
   steps before tells for each mask and step whether an earlier filter has taken the documents. That
   table has 32 x 600 rows whatever the input, so it is broadcast.
4. Cells meet the steps by mask; conditional sums are the counts of a step, and the removals of one
   filter, summed in a window over all orders of a part, are its Shapley total.

Edge cases: null text is empty, and the null source is the part of the empty string; empty texts are
copies of each other; of rows that share text and doc_id none is a copy of the other; a row without a
doc_id is no copy and has no labels; of several labels of a document the largest counts, and a label
that is null or missing counts as 0; very long texts are whole; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.llm import text as T

FILTERS = "ABCDE"
COPY = "E"


def failures(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails the filters that look at one document alone."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < 50,
        "B": 100 * distinct < 65 * n,
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: part, mask (bit 0 is filter A), good and toxic (0 or 1)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = [F.when(fails, 1 << FILTERS.index(k)).otherwise(0) for k, fails in failures(text).items()]
    own = T.stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            sum(bits[1:], bits[0]).alias("mask"),
        )
    )
    copied = T.stored(own.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("digest", "least"))
    judged = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    with_copies = own.join(copied, "digest", "left").withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("least"), 1 << FILTERS.index(COPY)).otherwise(0))
    is_one = lambda c: F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))
    return with_copies.select("doc_id", "part", "mask").join(judged, "doc_id", "left").select("part", "mask", is_one("quality").alias("good"), is_one("toxic").alias("toxic"))


def steps(spark: SparkSession) -> DataFrame:
    """mask, filter_order, step, filter, and what the step does to documents of that mask: earlier (an earlier filter took them), fails, only."""
    orders = spark.createDataFrame([("".join(p),) for p in permutations(FILTERS)], "filter_order string")
    each = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    each = each.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    cells = each.withColumn("bit", F.pow(F.lit(2), F.instr(F.lit(FILTERS), F.col("filter")) - 1).cast("int"))
    cells = cells.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))))
    cells = cells.withColumn("hit", F.col("bit").bitwiseAND(F.col("mask")))
    before = Window.partitionBy("mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("earlier", F.coalesce(F.bit_or("hit").over(before), F.lit(0)) > 0)
    return cells.select("mask", "filter_order", "step", "filter", "earlier", (F.col("hit") > 0).alias("fails"), (F.col("mask") == F.col("bit")).alias("only"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    cells = T.stored(masks(docs, labels).groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("n_good"), F.sum("toxic").alias("n_toxic")))
    met = cells.join(F.broadcast(steps(docs.sparkSession)), "mask")  # 32 x 600 rows at any size
    when = lambda c, n="n": F.sum(F.when(c, F.col(n)).otherwise(0))
    removed = ~F.col("earlier") & F.col("fails")
    counts = met.groupBy("part", "filter_order", "step", "filter").agg(
        when(~F.col("earlier") & ~F.col("fails")).alias("kept"),
        when(removed).alias("removed"),
        when(F.col("earlier") & F.col("fails")).alias("redundant"),
        when(F.col("only")).alias("unique_fails"),
        when(removed, "n_good").alias("good_lost"),
        when(removed, "n_toxic").alias("toxic_lost"),
    )
    total = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return counts.withColumn("shapley", total).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


#: The same over all documents, for DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(q = 1, false) AS good, coalesce(x = 1, false) AS toxic,
    list_value(len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
      100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
      regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)) AS bad
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, bad, count(*) AS n, sum(good::int) AS ng, sum(toxic::int) AS nt FROM f GROUP BY part, bad),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT part, filter_order, step, n, ng, nt, bad,
    ascii(substr(filter_order, step::int, 1)) - 64 AS k,
    list_bool_or(list_value(false) || list_transform(range(1, step), lambda i: bad[ascii(substr(filter_order, i::int, 1)) - 64])) AS earlier
  FROM c, orders, (SELECT unnest(range(1, 6)) AS step)),
g AS (
  SELECT part, filter_order, step, k,
    sum(CASE WHEN NOT earlier AND NOT bad[k] THEN n ELSE 0 END)::bigint AS kept,
    sum(CASE WHEN NOT earlier AND bad[k] THEN n ELSE 0 END)::bigint AS removed,
    sum(CASE WHEN earlier AND bad[k] THEN n ELSE 0 END)::bigint AS redundant,
    sum(CASE WHEN bad[k] AND len(list_filter(bad, lambda b: b)) = 1 THEN n ELSE 0 END)::bigint AS unique_fails,
    sum(CASE WHEN NOT earlier AND bad[k] THEN ng ELSE 0 END)::bigint AS good_lost,
    sum(CASE WHEN NOT earlier AND bad[k] THEN nt ELSE 0 END)::bigint AS toxic_lost
  FROM s GROUP BY part, filter_order, step, k)
SELECT part, filter_order, step::int AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, k))::bigint AS shapley
FROM g
"""
