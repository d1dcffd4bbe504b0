"""Queries of the evaluation and of the fitting around a model, over labels, documents, benchmark and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.operators import learn, metrics
from engramlake.plans.registry import query, table

_ROWS = """SELECT l.doc_id, l.quality + l.toxic AS gold, CASE WHEN l.doc_id % 5 = 0 THEN (l.quality + 1) % 3 ELSE l.quality + l.toxic END AS said, d.lang, d.source, d.text, (l.doc_id * 61 % 100) / 100.0 AS p
FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    r = table(spark, d, "labels").filter("quality is not null and toxic is not null").join(docs, "doc_id")
    said = F.when(F.col("doc_id") % 5 == 0, (F.col("quality") + 1) % 3).otherwise(F.col("quality") + F.col("toxic"))
    return r.select("doc_id", (F.col("quality") + F.col("toxic")).alias("gold"), said.alias("said"), "lang", "source", "text", ((F.col("doc_id") * 61 % 100) / 100.0).alias("p"))


def _scores_sql(by: str, rows: str = _ROWS) -> str:
    key, using = (f"{by}, ", f"{by}, ") if by else ("", "")
    return f"""WITH r AS ({rows}), lab AS (SELECT DISTINCT {key}gold AS label FROM r UNION SELECT DISTINCT {key}said FROM r), t AS (SELECT {', '.join(x for x in ('l.' + by if by else '', 'l.label') if x)}, count_if(r.gold = l.label) AS support,
count_if(r.said = l.label) AS saidn, count_if(r.gold = l.label AND r.said = l.label) AS hit FROM lab l JOIN r ON {'l.' + by + ' = r.' + by if by else 'true'} GROUP BY ALL)
SELECT {using}sum(support)::BIGINT AS n, round(sum(hit) / sum(support), 6) AS accuracy, round(avg(CASE WHEN support > 0 THEN hit / support END), 6) AS balanced_accuracy, round(avg(2 * hit / (support + saidn)), 6) AS macro_f1,
round(sum(support * 2 * hit / (support + saidn)) / sum(support), 6) AS weighted_f1 FROM t {'GROUP BY ' + by if by else ''}"""


@query(_scores_sql(""))
def classification_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.from_confusion(metrics.confusion(_rows(spark, d), "gold", "said"))


@query(_scores_sql("lang"))
def scores_by_language(spark: SparkSession, d: str) -> DataFrame:
    return metrics.from_confusion(metrics.confusion(_rows(spark, d), "gold", "said", ["lang"]), ["lang"])


@query(f"SELECT gold, said AS predicted, count(*) AS n FROM ({_ROWS}) GROUP BY 1, 2")
def confusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_rows(spark, d), "gold", "said")


@query(f"""SELECT lang, arg_max(gold, (n, -gold)) AS majority, max(n) AS n FROM (SELECT lang, gold, count(*) AS n FROM ({_ROWS}) GROUP BY 1, 2) GROUP BY 1""")
def majority_class(spark: SparkSession, d: str) -> DataFrame:
    return metrics.majority(_rows(spark, d), "gold", ["lang"])


@query(f"""WITH r AS ({_ROWS}), m AS (SELECT source, arg_max(gold, (n, -gold)) AS oracle FROM (SELECT source, gold, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1) SELECT doc_id, gold, oracle FROM r JOIN m USING (source)""")
def group_oracle(spark: SparkSession, d: str) -> DataFrame:
    return metrics.with_oracle(_rows(spark, d), "source", "gold").select("doc_id", "gold", "oracle")


@query(f"""WITH r AS (SELECT md5(text) AS s, * FROM ({_ROWS}) WHERE text IS NOT NULL), g AS (SELECT s, arg_max(gold, (n, -gold)) AS gold FROM (SELECT s, gold, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT s, arg_max(said, (n, -said)) AS said FROM (SELECT s, said, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1) SELECT gold, said AS predicted, count(*) AS n FROM g JOIN p USING (s) GROUP BY 1, 2""")
def sentence_confusion(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d).filter("text is not null").withColumn("s", F.md5("text"))
    return metrics.confusion(metrics.by_sentence(r, "s", "gold", "said"), "gold", "predicted")


@query(f"SELECT round(avg(-ln(greatest(list_extract([p + 0.01, 0.5, 1 - p], gold + 1) / (1.51), 1e-12))), 6) AS nll FROM ({_ROWS})")
def normalised_log_loss(spark: SparkSession, d: str) -> DataFrame:
    p = F.array(F.col("p") + 0.01, F.lit(0.5), 1 - F.col("p"))
    return metrics.log_loss(_rows(spark, d), p, F.col("gold"))


@query(f"SELECT lang, count_if(gold = 0) AS n_0, count_if(gold = 1) AS n_1, count_if(gold = 2) AS n_2, count_if(gold = 3) AS n_3 FROM ({_ROWS}) GROUP BY 1")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.class_counts(_rows(spark, d), "gold", [0, 1, 2, 3], ["lang"])


@query(f"SELECT gold, round(avg(p), 4) AS value FROM ({_ROWS}) GROUP BY 1")
def class_values(spark: SparkSession, d: str) -> DataFrame:
    return metrics.class_values(_rows(spark, d), "gold", "p")


@query(f"SELECT gold, count(*) AS n, round(sqrt(sum(count(*)) OVER () / (count(*) OVER () * count(*))), 6) AS weight FROM ({_ROWS}) GROUP BY 1")
def root_class_weights(spark: SparkSession, d: str) -> DataFrame:
    return metrics.class_weights(_rows(spark, d), ["gold"], root=True)


@query(f"""WITH g AS (SELECT unnest(range(101)) / 100.0 AS constant), a AS (SELECT constant, round(avg(CASE WHEN abs(p - constant) <= 0.15 THEN 1 ELSE 0 END), 6) AS agreement FROM ({_ROWS}), g GROUP BY 1)
SELECT constant, agreement, constant = (SELECT arg_max(constant, (agreement, -constant)) FROM a) AS best FROM a""")
def constant_baseline(spark: SparkSession, d: str) -> DataFrame:
    return metrics.constant_baseline(_rows(spark, d), "p")


@query(f"""WITH r AS ({_ROWS}), m AS (SELECT lang, avg(p) AS m, stddev_pop(p) AS s FROM r GROUP BY 1), f AS (SELECT lang, round(avg(CASE WHEN abs(p - m) > 5 * s THEN 1.0 ELSE 0 END), 6) AS far FROM r JOIN m USING (lang) GROUP BY 1),
a AS (SELECT x.lang, round(avg(CASE WHEN x.p > y.p THEN 1.0 WHEN x.p = y.p THEN 0.5 ELSE 0 END), 6) AS auc FROM r x JOIN r y ON x.lang = y.lang AND x.gold > 0 AND y.gold = 0 GROUP BY 1) SELECT lang, auc, far FROM f LEFT JOIN a USING (lang)""")
def auc_by_language(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auc_by(_rows(spark, d), "lang", "p", F.col("gold") > 0)


@query(f"""WITH r AS ({_ROWS}), m AS (SELECT avg(p) AS m, stddev_pop(p) AS s FROM r WHERE doc_id % 4 <> 0) SELECT doc_id, round((p - m) / s, 6) AS p FROM r, m""")
def standardized_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.standardized(_rows(spark, d).select("doc_id", "p"), ["p"], F.col("doc_id") % 4 != 0).select("doc_id", F.round("p", 6).alias("p"))


@query(f"""WITH r AS (SELECT *, len(list_filter(regexp_split_to_array(trim(text, ' '), '\\s+'), lambda w: w <> '')) AS w FROM ({_ROWS}) WHERE text IS NOT NULL), g AS (SELECT source, count(*) AS n, count(DISTINCT gold) AS k, stddev_pop(p) AS d, sum(w) AS w, max(w) AS longest FROM r GROUP BY 1)
SELECT sum(n)::BIGINT AS n, count(*) AS groups, count_if(n = 1) AS singletons, count_if(k > 1) AS disagreeing, round(avg(CASE WHEN n > 1 THEN d END), 6) AS deviation_within, round(sum(w) / sum(n), 4) AS mean_words, max(longest) AS longest FROM g""")
def dataset_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.diagnostics(_rows(spark, d).filter("text is not null"), "source", "gold", "p", "text")


@query("""WITH f AS (SELECT user_id, min(event_id) AS a FROM events GROUP BY 1) SELECT event_id, user_id, dense_rank() OVER (ORDER BY a) - 1 AS code FROM events JOIN f USING (user_id)""")
def group_codes(spark: SparkSession, d: str) -> DataFrame:
    return metrics.group_codes(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id")


@query()
def macro_f1_interval(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bootstrap_macro_f1(_rows(spark, d), F.col("doc_id"), "gold", "said", 100)


_FOUND = "SELECT item_id AS query_id, item_id % 3 AS k, CASE WHEN item_id % 4 = 0 THEN 0.0 ELSE 1.0 END AS hit, 1.0 / (item_id % 5 + 1) AS mrr, CASE WHEN item_id % 8 = 0 THEN 0.0 ELSE 1.0 END AS pool_hit, CASE WHEN item_id % 2 = 0 THEN 'full' ELSE 'keyword' END AS arm FROM benchmark"


def _found(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    zero = lambda n: F.when(i % n == 0, 0.0).otherwise(1.0)
    return table(spark, d, "benchmark").select(i.alias("query_id"), (i % 3).alias("k"), zero(4).alias("hit"), (1.0 / (i % 5 + 1)).alias("mrr"), zero(8).alias("pool_hit"), F.when(i % 2 == 0, "full").otherwise("keyword").alias("arm"))


@query(f"SELECT arm, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr, round(avg(pool_hit), 6) AS pool_hit, round(avg(hit) / nullif(avg(pool_hit), 0), 6) AS recovery FROM ({_FOUND}) GROUP BY 1")
def arm_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.arm_summary(_found(spark, d))


@query(f"SELECT CASE WHEN k = 0 THEN 'none' WHEN k = 1 THEN '1' WHEN k <= 3 THEN '2-3' ELSE '4+' END AS key, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr FROM ({_FOUND}) GROUP BY 1")
def gold_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return metrics.breakdown(_found(spark, d), metrics.gold_bucket(F.col("k")), ["hit", "mrr"])


@query(f"SELECT coalesce(arm, 'all') AS arm, count(*) AS n, round(avg(hit), 6) AS hit, count_if(k = 0) AS n_0, count_if(k = 1) AS n_1, count_if(k = 2) AS n_2 FROM ({_FOUND}) GROUP BY ROLLUP (arm)")
def summary_with_total(spark: SparkSession, d: str) -> DataFrame:
    return metrics.with_total(_found(spark, d), "arm", ["hit"], ("k", [0, 1, 2]))


@query(f"SELECT query_id, arm FROM ({_FOUND}) WHERE hit = 0 ORDER BY query_id LIMIT 5")
def failure_cases(spark: SparkSession, d: str) -> DataFrame:
    return metrics.failures(_found(spark, d), 5).select("query_id", "arm")


_CONTEXT = "SELECT item_id AS query_id, doc_id AS id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS place, d.text FROM benchmark b JOIN documents d ON d.doc_id % 97 = b.item_id % 97 AND d.text IS NOT NULL QUALIFY place <= 5"
_TOKENS = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'))"
_FLAT = "' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), ' ') || ' '"


def _context(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 97).alias("k"))
    docs = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 97).alias("k"))
    w = Window.partitionBy("query_id").orderBy("id")
    return b.join(docs, "k").withColumn("place", F.row_number().over(w)).filter("place <= 5").select("query_id", "id", "place", "text")


@query(f"""WITH c AS ({_CONTEXT}), s AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON d.doc_id % 97 = b.item_id % 97 AND d.doc_id % 2 = 0), m AS (SELECT query_id, count(*) AS m FROM c JOIN s USING (query_id, id) GROUP BY 1)
SELECT query_id, round(coalesce(m, 0) / c.n, 6) AS precision, round(coalesce(m, 0) / s.n, 6) AS recall FROM (SELECT query_id, count(*) AS n FROM c GROUP BY 1) c FULL OUTER JOIN (SELECT query_id, count(*) AS n FROM s GROUP BY 1) s USING (query_id) LEFT JOIN m USING (query_id)""")
def context_quality(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 97).alias("k"))
    s = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 97).alias("k")).filter("id % 2 = 0")
    return metrics.context_quality(_context(spark, d), b.join(s, "k").select("query_id", "id"))


@query(f"""WITH c AS (SELECT *, {_FLAT} AS flat FROM ({_CONTEXT})), f AS (SELECT item_id AS query_id, ' ' || trim(regexp_extract(lower(text), '[a-z]+')) || ' ' AS form FROM benchmark), q AS (SELECT query_id, id FROM c WHERE id % 2 = 0 UNION SELECT item_id, -1 FROM benchmark),
h AS (SELECT c.query_id, c.id, c.place, contains(flat, form) AS holds, c.id % 2 = 0 AS relevant FROM c JOIN f USING (query_id)), g AS (SELECT query_id, bool_or(holds AND relevant) AS grounded, bool_or(holds AND place = 1) AS top1, bool_or(place = 1 AND relevant) AS first FROM h GROUP BY 1)
SELECT query_id, coalesce(grounded, false) AS grounded, coalesce(top1, false) AS top1, coalesce(first, false) AS first FROM (SELECT DISTINCT query_id FROM q) LEFT JOIN g USING (query_id)""")
def grounded_answers(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    c = _context(spark, d)
    qrels = c.filter("id % 2 = 0").select("query_id", "id", F.lit(1).alias("grade")).unionByName(b.select(F.col("item_id").alias("query_id"), F.lit(-1).cast("bigint").alias("id"), F.lit(1).alias("grade")))
    return metrics.grounded(c, qrels, b.select(F.col("item_id").alias("query_id"), F.regexp_extract(F.lower("text"), "[a-z]+", 0).alias("form")))


@query(f"""WITH q AS (SELECT item_id AS query_id, {_TOKENS} AS q FROM benchmark), g AS (SELECT query_id, list_distinct(flatten(list({_TOKENS}))) AS g FROM ({_CONTEXT}) GROUP BY 1)
SELECT query_id, round(len(list_intersect(q, g)) / len(q), 6) AS share FROM q JOIN g USING (query_id) WHERE len(q) > 0 ORDER BY share DESC, query_id LIMIT 10""")
def wording_leakage(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return metrics.leakage(q, _context(spark, d), 10)


@query("""SELECT key, old, new, new - old AS delta, CASE WHEN old IS NULL THEN 'new' WHEN new IS NULL THEN 'old' END AS only FROM (VALUES ('hit', 0.5), ('mrr', 0.25)) a(key, old) FULL OUTER JOIN (VALUES ('hit', 0.75), ('ndcg', 0.5)) b(key, new) USING (key)""")
def report_delta(spark: SparkSession, d: str) -> DataFrame:
    """Two nested reports as keys and numbers, without what only tells how they were made."""
    reports = ({"hit": 0.5, "mrr": 0.25, "protocol": {"k": 5}}, {"hit": 0.75, "ndcg": 0.5, "manifest": {"seed": 1}, "note": "x"})
    a, b = (spark.createDataFrame(list(metrics.flattened(r).items()), "key string, value double").filter(metrics.is_metric(F.col("key"))) for r in reports)
    return metrics.snapshot_delta(a, b).withColumns({c: F.col(c).cast("double") for c in ("old", "new", "delta")})


@query(f"SELECT rule, n FROM (SELECT 'no_text' AS rule, count_if(text IS NULL) AS n FROM benchmark UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT item_id FROM benchmark GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'no_words', count_if(len({_TOKENS}) = 0) FROM benchmark)")
def benchmark_violations(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    return metrics.violations({"no_text": b.filter("text is null"), "repeated_id": b.groupBy("item_id").count().filter("count > 1"), "no_words": b.filter(F.size(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), 0)) == 0)})


# --- fitting --------------------------------------------------------------------------------------

_THREE = "SELECT doc_id, gold, [exp((doc_id % 7) / 2.0), exp((doc_id % 5) / 2.0), exp((doc_id % 3) / 2.0)] AS e FROM (" + _ROWS + ")"


def _three(spark: SparkSession, d: str) -> DataFrame:
    logits = F.array(*[(F.col("doc_id") % n) / 2.0 for n in (7, 5, 3)])
    return _rows(spark, d).select("doc_id", F.col("gold").alias("label"), logits.alias("logits"))


@query(f"""WITH p AS (SELECT doc_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM ({_THREE})), q AS (SELECT doc_id, p, [p[1] * 1.5, p[2], p[3] * 0.75] AS w FROM p)
SELECT doc_id, round(p[1], 6) AS p0, round(p[2], 6) AS p1, round(p[3], 6) AS p2, list_position(w, list_max(w)) - 1 AS said FROM q""")
def class_probabilities(spark: SparkSession, d: str) -> DataFrame:
    p = _three(spark, d).withColumn("p", learn.softmax(F.col("logits")))
    return p.select("doc_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)], learn.weighted_class(F.col("p"), [1.5, 1.0, 0.75]).alias("said"))


@query()
def class_weight_grid(spark: SparkSession, d: str) -> DataFrame:
    p = _three(spark, d).select("label", learn.softmax(F.col("logits")).alias("p"))
    return learn.class_weight_grid(p)


@query(f"""WITH w AS (SELECT unnest(range(21)) / 20.0 AS weight), r AS (SELECT gold, weight, [weight * e[1] / list_sum(e) + (1 - weight) / 3, weight * e[2] / list_sum(e) + (1 - weight) / 3, weight * e[3] / list_sum(e) + (1 - weight) / 3] AS p FROM ({_THREE}), w)
SELECT weight, round(avg(-ln(p[gold + 1])), 6) AS nll FROM r GROUP BY 1""")
def blend_losses(spark: SparkSession, d: str) -> DataFrame:
    r = _three(spark, d).select("label", learn.softmax(F.col("logits")).alias("a"), F.array(*[F.lit(1 / 3)] * 3).alias("b"))
    return learn.blend_grid(r).select("weight", "nll")


@query("SELECT true AS near")
def fitted_temperature(spark: SparkSession, d: str) -> DataFrame:
    """Labels drawn from logits that were made three times too sharp give a temperature near three."""
    rows = spark.range(30_000).select(F.array(*[F.sin(F.col("id") * k) * 2 for k in (1.3, 2.1, 3.7)]).alias("true"), (F.xxhash64("id") / 2.0**64 + 0.5).alias("u"))
    rows = rows.withColumn("p", learn.softmax(F.col("true")))
    label = F.when(F.col("u") < F.col("p")[0], 0).when(F.col("u") < F.col("p")[0] + F.col("p")[1], 1).otherwise(2)
    t = learn.fit_temperature(rows.select(F.transform("true", lambda x: x * 3).alias("logits"), label.alias("label")))
    return spark.createDataFrame([(abs(t - 3) < 0.15,)], "near boolean")


@query("SELECT problem, 0::BIGINT AS n FROM (VALUES ('no_split'), ('repeated'), ('torn_group')) t(problem)")
def split_integrity(spark: SparkSession, d: str) -> DataFrame:
    parts = learn.split(_rows(spark, d), "source", "gold", {"fit": 0.7, "val": 0.15, "test": 0.15})
    return learn.split_problems(parts, "source", "doc_id")


@query(f"SELECT CASE WHEN p < 0.4 THEN 0 WHEN p < 0.7 THEN 1 ELSE 2 END AS class, count(*) AS n FROM ({_ROWS}) GROUP BY 1")
def score_classes(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).groupBy(learn.score_class(F.col("p")).alias("class")).agg(F.count("*").alias("n"))
