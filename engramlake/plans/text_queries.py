"""Queries over texts: tokens, redaction, scoring, retrieval, duplicates and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.functions import rules, scoring
from engramlake.operators import metrics, reconcile, retrieval
from engramlake.plans.registry import at, query, table

NOW = "2024-02-01"
_TOKENS = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'))"
_COVER = f"""q AS (SELECT item_id AS query_id, {_TOKENS} AS t FROM benchmark), qt AS (SELECT query_id, len(t) AS n, unnest(t) AS word FROM q),
dt AS (SELECT doc_id AS id, unnest({_TOKENS}) AS word FROM documents), h AS (SELECT query_id, id, count(*) AS shared, round(count(*) / max(n), 6) AS coverage FROM qt JOIN dt USING (word) GROUP BY 1, 2)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang", "n_chars")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_COVER} SELECT query_id, id, shared, coverage, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, id) AS rank FROM h QUALIFY rank <= 5")
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.keyword_hits(_asked(spark, d), _docs(spark, d), 5)


@query(f"SELECT doc_id, len(t) AS n_tokens, list_max([length(x) for x in t]) AS longest FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", rules.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_max(F.transform("t", lambda x: F.length(x))).cast("bigint").alias("longest"))


@query(f"""SELECT word, ('0x' || substr(sha256(word), 1, 8))::UBIGINT % 512 AS slot, count(*) AS n_docs FROM (SELECT unnest({_TOKENS}) AS word FROM documents) GROUP BY 1""")
def lexical_hash(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select(F.explode(rules.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n_docs"))
    return w.select("word", rules.lexical_slot(F.col("word")).alias("slot"), "n_docs")


@query("""SELECT doc_id, regexp_replace(text, '(^|[^\\p{L}\\p{N}_.+-])[\\p{L}\\p{N}_.+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '\\1[REDACTED_EMAIL]', 'g') AS text,
regexp_matches(text, '(^|[^\\p{L}\\p{N}_.+-])[\\p{L}\\p{N}_.+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS has_email FROM documents""")
def redact_email(spark: SparkSession, d: str) -> DataFrame:
    pattern = dict((n, p) for n, p, _ in rules.SENSITIVE)["email"]
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("text", pattern, "[REDACTED_EMAIL]").alias("text"), F.col("text").rlike(pattern).alias("has_email"))


@query()
def redact_all(spark: SparkSession, d: str) -> DataFrame:
    text, found = rules.redact(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.alias("text"), F.array_join(found, ",").alias("found"))


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_''-]*[\\p{L}\\p{M}\\p{N}_][\\p{L}\\p{M}\\p{N}_''-]*')"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    category = F.when(F.col("role") == "user", "semantic").when(F.col("role") == "system", "procedural").otherwise("temporary")
    f = scoring.features(F.col("text"), F.col("category"), F.col("created_at"), at(NOW), F.col("turn"), F.col("turn") / 4.0)
    c = c.withColumn("category", category).withColumn("created_at", F.lit("2024-01-31 12:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("turn").cast("int")))
    return c.withColumns({k: v for k, v in f.items() if k != "turn"})


#: Letters beyond ASCII as underscores and other signs beyond ASCII as hyphens, so that both engines part words at the same places.
_FLAT = "regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\p{L}\\p{M}\\p{N}]', '-', 'g'), '[^\\x00-\\x7F]', '_', 'g')"


@query(f"""SELECT conv_id, turn, round(greatest(0, 1 - least(epoch(TIMESTAMP '2024-02-01' - (TIMESTAMP '2024-01-31 12:00:00' + INTERVAL 1 HOUR * turn)) / 86400, 1)), 6) AS recency,
round(least(turn / 10, 1), 6) AS access_frequency, round(least(turn / 4, 1), 6) AS interaction_signal,
round(least(len(regexp_extract_all({_FLAT}, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\b')) / greatest(len({_WORDS}), 1), 1), 6) AS entity_density,
round(least(len({_WORDS}) / 80, 1), 6) AS word_count_norm FROM conversations""")
def feature_vector(spark: SparkSession, d: str) -> DataFrame:
    names = ("recency", "access_frequency", "interaction_signal", "entity_density", "word_count_norm")
    return _scored(spark, d).select("conv_id", "turn", *[F.round(n, 6).alias(n) for n in names])


@query()
def heuristic_importance(spark: SparkSession, d: str) -> DataFrame:
    c = _scored(spark, d)
    return c.select("conv_id", "turn", "category", scoring.importance({k: F.col(k) for k in (*scoring.WEIGHTS, "category_temporary")}).alias("importance"))


_RECORDS = """SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'semantic' WHEN 1 THEN 'episodic' WHEN 2 THEN 'procedural' WHEN 3 THEN 'preference' WHEN 4 THEN 'task' ELSE 'temporary' END AS category,
 (doc_id * 37 % 100) / 100.0 AS score, doc_id % 5 = 0 AS closed, doc_id % 3 = 0 AS recurs, doc_id % 4 AS access_count, TIMESTAMP '2023-09-01' + INTERVAL 1 DAY * (doc_id % 150) AS created_at FROM documents"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    names = ("semantic", "episodic", "procedural", "preference", "task", "temporary")
    category = F.element_at(F.array(*[F.lit(n) for n in names]), (i % 6 + 1).cast("int"))
    return table(spark, d, "documents").select(
        i.alias("id"), category.alias("category"), ((i * 37 % 100) / 100.0).alias("score"), (i % 5 == 0).alias("closed"), (i % 3 == 0).alias("recurs"), (i % 4).alias("access_count"),
        (at("2023-09-01") + F.make_dt_interval(days=(i % 150).cast("int"))).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("seen"),
    )


_TIER = """CASE WHEN category = 'task' AND closed THEN 'archive' WHEN archive THEN 'archive' WHEN category = 'temporary' OR score < 0.25 THEN 'working' WHEN category = 'task' AND NOT recurs THEN 'short_term'
 WHEN category IN ('semantic', 'preference', 'procedural', 'task') AND score >= 0.42 THEN 'long_term' ELSE 'short_term' END"""
_ARCHIVE = "category <> 'task' AND created_at <= TIMESTAMP '2024-02-01' - INTERVAL 90 DAY AND (access_count > 0 OR score >= 0.42)"
_TIERED = f"SELECT *, {_TIER} AS tier FROM (SELECT *, {_ARCHIVE} AS archive FROM ({_RECORDS}))"


def _tiered(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    r = _records(spark, d)
    r = r.withColumn("archive", scoring.should_archive(at(NOW), scoring.last_activity("created_at", "seen", "seen"), c("category"), c("access_count"), c("score")))
    return r.withColumn("tier", scoring.tier(c("category"), c("score"), c("closed"), c("recurs"), c("archive")))


@query(f"SELECT id, category, archive, tier FROM ({_TIERED})")
def tier_assign(spark: SparkSession, d: str) -> DataFrame:
    return _tiered(spark, d).select("id", "category", "archive", "tier")


@query(f"""SELECT id, strftime(CASE WHEN category = 'task' AND (closed OR recurs) THEN NULL WHEN category = 'task' THEN created_at + INTERVAL 31 HOUR WHEN tier = 'working' THEN created_at + INTERVAL 1 HOUR
WHEN tier = 'short_term' AND category = 'episodic' AND id % 2 = 0 THEN created_at + INTERVAL 90 DAY WHEN tier = 'short_term' THEN created_at + INTERVAL 14 DAY END, '%Y-%m-%d %H') AS expires FROM ({_TIERED})""")
def expiry_assign(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    due = F.when(c("category") == "task", c("created_at") + F.make_dt_interval(hours=F.lit(7)))
    e = scoring.expiry(c("category"), c("tier"), c("closed"), c("recurs"), due, c("created_at"), c("id") % 2 == 0)
    return _tiered(spark, d).select("id", F.date_format(e, "yyyy-MM-dd HH").alias("expires"))


@query(f"""WITH {_COVER}, t AS ({_TIERED}) SELECT query_id, id, round((0.65 * coverage + 0.1 * CASE category WHEN 'semantic' THEN 1 WHEN 'preference' THEN 1 WHEN 'procedural' THEN 0.9 WHEN 'task' THEN 0.9 WHEN 'episodic' THEN 0.6 ELSE 0.1 END
 + 0.05 * CASE tier WHEN 'long_term' THEN 1 WHEN 'short_term' THEN 0.7 WHEN 'working' THEN 0.4 ELSE 0.2 END + 0.1 * pow(2, -greatest(0, epoch(TIMESTAMP '2024-02-01' - created_at) / 86400) / 30) + 0.1 * score), 5) AS score
 FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, id) <= 20) JOIN t USING (id)""")
def keyword_rank(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    hits = retrieval.keyword_hits(_asked(spark, d), _docs(spark, d), 20).join(_tiered(spark, d), "id")
    return hits.select("query_id", "id", F.round(scoring.rank_score(c("coverage"), c("category"), c("tier"), scoring.half_life(c("created_at"), at(NOW)), c("score")), 5).alias("score"))


_CHANNELS = f"""{_COVER}, ch AS (SELECT query_id, 'keyword' AS channel, id, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, id) AS rank FROM h QUALIFY rank <= 30 UNION ALL
SELECT query_id, 'recency', id, r FROM (SELECT item_id AS query_id FROM benchmark), (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents QUALIFY r <= 30))"""


def _channels(spark: SparkSession, d: str) -> DataFrame:
    k = retrieval.keyword_hits(_asked(spark, d), _docs(spark, d), 30).select("query_id", F.lit("keyword").alias("channel"), "id", "rank")
    # a channel that no query changes: its first rows are found once, and are few
    top = _docs(spark, d).orderBy(F.col("n_chars").desc(), F.col("id").desc()).limit(30).select("id", "n_chars")
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n_chars").desc(), F.col("id").desc())))
    r = _asked(spark, d).select("query_id").crossJoin(F.broadcast(top)).select("query_id", F.lit("recency").alias("channel"), "id", "rank")
    return k.unionByName(r)


@query(f"""WITH {_CHANNELS}, f AS (SELECT query_id, id, round(sum(CASE channel WHEN 'keyword' THEN 0.3 ELSE 1.0 END / (60 + rank)) + 0.002 * (count(DISTINCT channel) - 1), 9) AS score, count(DISTINCT channel) AS n_channels FROM ch GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fused(_channels(spark, d))


@query(f"""WITH {_CHANNELS}, f AS (SELECT query_id, id, round(sum(CASE channel WHEN 'keyword' THEN 0.3 ELSE 1.0 END / (60 + rank)) + 0.002 * (count(DISTINCT channel) - 1), 9) AS score FROM ch GROUP BY 1, 2),
hd AS (SELECT query_id, id, round(sum(CASE channel WHEN 'keyword' THEN 0.3 ELSE 1.0 END / (60 + rank)) + 0.002 * (count(DISTINCT channel) - 1), 9) AS head FROM ch WHERE rank <= 10 GROUP BY 1, 2)
SELECT f.query_id, f.id, head IS NULL AS is_tail, coalesce(head, score) AS score, row_number() OVER (PARTITION BY f.query_id ORDER BY head IS NULL, coalesce(head, score) DESC, f.id) AS rank FROM f LEFT JOIN hd ON f.query_id = hd.query_id AND f.id = hd.id""")
def rrf_head_tail(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.head_and_tail(_channels(spark, d), 10)


@query("""WITH RECURSIVE c AS (SELECT doc_id AS id, text, 0 AS s, 0 AS depth FROM documents WHERE length(text) > 0 UNION ALL
SELECT id, text, greatest(s + 1, e - 150), depth + 1 FROM (SELECT *, CASE WHEN s + 1000 >= length(text) THEN length(text) WHEN instr(reverse(substr(text, s + 501, 500)), ' ') > 0 THEN s + 1000 - instr(reverse(substr(text, s + 501, 500)), ' ') ELSE s + 1000 END AS e FROM c) WHERE e < length(text))
SELECT id, id || ':' || s AS chunk_id, s AS start, CASE WHEN s + 1000 >= length(text) THEN length(text) WHEN instr(reverse(substr(text, s + 501, 500)), ' ') > 0 THEN s + 1000 - instr(reverse(substr(text, s + 501, 500)), ' ') ELSE s + 1000 END AS "end" FROM c""")
def chunking(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.chunks(_docs(spark, d)).select("id", "chunk_id", "start", "end")


@query(f"WITH {_COVER} SELECT query_id, count(*) AS n FROM h GROUP BY 1")
def candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    asked = _asked(spark, d).select("query_id", F.explode(rules.tokens(F.col("text"))).alias("word"))
    held = _docs(spark, d).select("id", F.explode(rules.tokens(F.col("text"))).alias("word"))
    return asked.join(held, "word").select("query_id", "id").distinct().groupBy("query_id").agg(F.count("*").alias("n"))


@query()
def context_build(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.keyword_hits(_asked(spark, d), _docs(spark, d), 20).join(_docs(spark, d).select("id", "text"), "id")
    return retrieval.contexts(hits, 6000)


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return t.filter("n > 1")


@query(f"""WITH s AS (SELECT min(doc_id) AS id, t FROM (SELECT doc_id, list_sort({_TOKENS}) AS t FROM documents) WHERE len(t) > 0 GROUP BY t), w AS (SELECT id, len(t) AS n, unnest(t) AS word FROM s),
p AS (SELECT a.id AS left_id, b.id AS right_id, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM w a JOIN w b ON a.word = b.word AND a.id < b.id GROUP BY 1, 2)
SELECT left_id, right_id, round(shared / (na + nb - shared), 6) AS similarity FROM p WHERE round(shared / (na + nb - shared), 6) >= 0.75""")
def jaccard_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.similar_pairs(_docs(spark, d))


_CLAIMS = "SELECT user_id, event_type AS subject, 'k' || (event_id % 40) AS predicate, event_id AS id, CAST(value AS INT) % 3 AS value, event_id % 2 = 0 AS positive, event_id % 3 <> 0 AS exclusive FROM events"


@query(f"""WITH c AS ({_CLAIMS}) SELECT a.user_id, a.subject, a.predicate, a.id AS left_id, b.id AS right_id FROM c a JOIN c b USING (user_id, subject, predicate) WHERE a.id < b.id
AND ((a.value = b.value AND a.positive <> b.positive) OR (a.exclusive AND b.exclusive AND a.positive AND b.positive AND a.value <> b.value))""")
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    c = table(spark, d, "events").select(
        "user_id", F.col("event_type").alias("subject"), F.concat(F.lit("k"), (i % 40).cast("string")).alias("predicate"), i.alias("id"),
        (F.rint("value").cast("int") % 3).alias("value"), (i % 2 == 0).alias("positive"), (i % 3 != 0).alias("exclusive"),
    )
    return reconcile.contradictions(c)


@query("""SELECT user_id, event_type, arg_max(event_id, (event_id % 3, round(value, 1), ts, -event_id)) AS winner, count(*) AS n FROM events GROUP BY 1, 2""")
def support_rank(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("id"), (F.col("event_id") % 3).alias("source_priority"), F.round("value", 1).alias("confidence"), F.col("ts").alias("observed_at"), F.lit(0).alias("importance"))
    return reconcile.support(e, ["user_id", "event_type"])


_PREDICTED = "SELECT doc_id, quality, toxic, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS predicted, (doc_id * 61 % 100) / 100.0 AS p FROM labels"


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("quality")
    return table(spark, d, "labels").withColumns({"predicted": F.when(F.col("doc_id") % 4 == 0, 1 - q).otherwise(q), "p": (F.col("doc_id") * 61 % 100) / 100.0})


@query(f"""WITH r AS ({_PREDICTED}), l AS (SELECT unnest([0, 1]) AS label), t AS (SELECT label, count_if(quality = label) AS support, count_if(predicted = label) AS said, count_if(quality = label AND predicted = label) AS hit FROM r, l GROUP BY 1)
SELECT label, support, round(hit / said, 6) AS precision, round(hit / support, 6) AS recall, round(2 * (hit / said) * (hit / support) / ((hit / said) + (hit / support)), 6) AS f1 FROM t""")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_class(_predicted(spark, d), "quality", "predicted")


@query(f"""WITH b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS c, avg(quality) AS y FROM ({_PREDICTED}) GROUP BY 1) SELECT round(sum(n * abs(c - y)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM b""")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration_error(_predicted(spark, d), F.col("p"), F.col("quality"))


@query(f"SELECT round(avg(-ln(greatest(CASE WHEN quality = 1 THEN p ELSE 1 - p END, 1e-12))), 6) AS nll FROM ({_PREDICTED})")
def log_loss(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("quality") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return _predicted(spark, d).agg(F.round(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))), 6).alias("nll"))


@query(f"WITH r AS ({_PREDICTED}) SELECT round(avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END), 6) AS auc FROM r a JOIN r b ON a.quality = 1 AND b.quality = 0")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(_predicted(spark, d), F.col("p"), F.col("quality") == 1)


@query(f"WITH g AS (SELECT unnest(range(101)) / 100.0 AS constant) SELECT constant, round(avg(CASE WHEN abs(p - constant) <= 0.15 THEN 1 ELSE 0 END), 6) AS agreement FROM ({_PREDICTED}), g GROUP BY 1")
def constant_baseline_grid(spark: SparkSession, d: str) -> DataFrame:
    p = _predicted(spark, d).groupBy("p").agg(F.count("*").alias("n"))  # a row for each distinct score
    grid = spark.range(101).select((F.col("id") / 100.0).alias("constant"))
    return p.crossJoin(F.broadcast(grid)).groupBy("constant").agg(F.round(F.sum(F.when(F.abs(F.col("p") - F.col("constant")) <= 0.15, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("agreement"))


@query(f"""WITH {_COVER}, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, id) AS rank FROM h QUALIFY rank <= 10),
g AS (SELECT item_id AS query_id, doc_id AS id, doc_id % 4 AS grade FROM benchmark, documents WHERE doc_id % 50 = item_id % 50 AND doc_id % 4 > 0),
i AS (SELECT query_id, count(*) AS relevant, sum((pow(2, grade) - 1) / log2(n + 1)) FILTER (n <= 5) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS n FROM g) GROUP BY 1),
m AS (SELECT query_id, count_if(rank <= 5) AS found, min(rank) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 5) AS dcg FROM r JOIN g USING (query_id, id) GROUP BY 1)
SELECT q.query_id, CASE WHEN relevant IS NOT NULL THEN round(coalesce(found / relevant, 0), 6) END AS recall, CASE WHEN relevant IS NOT NULL THEN CASE WHEN found > 0 THEN 1.0::DOUBLE ELSE 0.0 END END AS hit,
CASE WHEN relevant IS NOT NULL THEN round(coalesce(1 / first, 0), 6) END AS mrr, CASE WHEN relevant IS NOT NULL THEN round(coalesce(dcg / ideal, 0), 6) END AS ndcg
FROM (SELECT query_id FROM r UNION SELECT query_id FROM g) q LEFT JOIN i USING (query_id) LEFT JOIN m USING (query_id)""")
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    ranked = retrieval.keyword_hits(_asked(spark, d), _docs(spark, d), 10)
    items = _asked(spark, d).select("query_id", (F.col("query_id") % 50).alias("k"))
    grades = _docs(spark, d).select("id", (F.col("id") % 50).alias("k"), (F.col("id") % 4).alias("grade")).filter("grade > 0")
    return metrics.ranking(ranked, items.join(grades, "k").select("query_id", "id", "grade"), 5)


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bootstrap_mean(table(spark, d, "labels"), F.col("doc_id"), F.col("quality"))


@query("SELECT quality, toxic, count(*) AS n, round(sum(count(*)) OVER () / (4.0 * count(*)), 6) AS weight FROM labels GROUP BY 1, 2")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))  # one row
    return c.crossJoin(F.broadcast(total)).select("quality", "toxic", "n", F.round(F.col("total") / (4.0 * F.col("n")), 6).alias("weight"))


@query("SELECT count(*) AS pairs, round(avg(CASE WHEN doc_id % 4 = 0 THEN 1 - 2 * quality ELSE 0 END), 6) AS mean_difference FROM labels WHERE quality IS NOT NULL")
def paired_difference(spark: SparkSession, d: str) -> DataFrame:
    return _paired(spark, d).select("pairs", F.round("mean_difference", 6).alias("mean_difference"))


def _paired(spark: SparkSession, d: str) -> DataFrame:
    rows = _predicted(spark, d)
    return metrics.paired(rows.select("doc_id", F.col("quality").alias("v")), rows.select("doc_id", F.col("predicted").alias("v")), "doc_id", "v", 200)


@query()
def paired_comparison(spark: SparkSession, d: str) -> DataFrame:
    return _paired(spark, d)


@query()
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cluster_bootstrap(table(spark, d, "events"), F.col("user_id"), F.col("value"), 200)


@query(f"""WITH {_COVER}, r AS (SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, id) AS rank FROM h) WHERE rank <= 10),
g AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark, documents WHERE doc_id % 50 = item_id % 50 AND doc_id % 4 > 0),
m AS (SELECT g.query_id, max(CASE WHEN r.id IS NULL THEN 0.0::DOUBLE ELSE 1.0 END) AS pool_hit, round(count(r.id) / count(*), 6) AS pool_recall FROM g LEFT JOIN r USING (query_id, id) GROUP BY 1)
SELECT q.query_id, pool_hit, pool_recall FROM (SELECT query_id FROM r UNION SELECT query_id FROM g) q LEFT JOIN m USING (query_id)""")
def pool_metrics(spark: SparkSession, d: str) -> DataFrame:
    ranked = retrieval.keyword_hits(_asked(spark, d), _docs(spark, d), 10)
    items = _asked(spark, d).select("query_id", (F.col("query_id") % 50).alias("k"))
    grades = _docs(spark, d).select("id", (F.col("id") % 50).alias("k"), (F.col("id") % 4).alias("grade")).filter("grade > 0")
    return metrics.pool(ranked, items.join(grades, "k").select("query_id", "id", "grade"))


@query(f"""SELECT answered, missed, abstained, invented, round((answered / (answered + missed) + abstained / (abstained + invented)) / 2, 6) AS balanced_accuracy FROM (SELECT count_if(quality = 1 AND p >= 0.5) AS answered,
count_if(quality = 1 AND p < 0.5) AS missed, count_if(quality = 0 AND p < 0.5) AS abstained, count_if(quality = 0 AND p >= 0.5) AS invented FROM ({_PREDICTED}))""")
def answerability(spark: SparkSession, d: str) -> DataFrame:
    return metrics.answerability(_predicted(spark, d), F.col("quality") == 1, F.col("p") >= 0.5)


@query("""SELECT event_id, CASE WHEN event_id % 3 <> other % 3 THEN 'source_priority' WHEN round(value, 0) <> round(v, 0) THEN 'confidence' WHEN ts <> t THEN 'observation_time' ELSE 'tie_kept_existing' END AS reason
FROM (SELECT event_id, value, ts, lag(event_id) OVER w AS other, lag(value) OVER w AS v, lag(ts) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE other IS NOT NULL""")
def decision_reason(spark: SparkSession, d: str) -> DataFrame:
    mine = F.struct((F.col("event_id") % 3).alias("source_priority"), F.round("value", 0).alias("confidence"), F.col("ts").alias("observed_at"), F.lit(0).alias("importance"))
    e = table(spark, d, "events").select("event_id", "user_id", mine.alias("a"))
    e = e.withColumn("b", F.lag("a").over(Window.partitionBy("user_id").orderBy("event_id"))).filter("b is not null")
    return e.select("event_id", reconcile.deciding("a", "b").alias("reason"))
