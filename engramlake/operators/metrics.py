"""Metrics of retrieval, classification and calibration, as aggregations; bootstrap intervals as resampled joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import rules


def ranking(ranked: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, recall, hit, mrr, ndcg) at ``k``; null without relevant items. Later repeats of an id do not count.

    ``ranked``: query_id, id, rank; ``qrels``: query_id, id, grade.
    """
    once = ranked.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    once = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    wanted = qrels.filter("grade > 0")
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    ideal = wanted.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "id")))
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("n") <= k, gain(F.col("grade"), F.col("n")))).alias("ideal"))
    met = once.join(wanted, ["query_id", "id"])
    met = met.groupBy("query_id").agg(
        F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, gain(F.col("grade"), F.col("rank")))).alias("dcg")
    )
    every = ranked.select("query_id").union(qrels.select("query_id")).distinct().join(ideal, "query_id", "left").join(met, "query_id", "left")
    have = F.col("relevant").isNotNull()
    zero = lambda c: F.when(have, F.round(F.coalesce(c, F.lit(0.0)), 6))
    return every.select(
        "query_id", zero(F.col("found") / F.col("relevant")).alias("recall"), zero((F.col("found") > 0).cast("double")).alias("hit"),
        zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / F.col("ideal")).alias("ndcg"),
    )


def by_class(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1) of each label that is given or predicted."""
    cells = rows.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    long = cells.select(F.explode(F.array(F.struct(F.col("g").alias("label"), F.col("n").alias("gold"), F.lit(0).cast("bigint").alias("said"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("gold"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hit")))).alias("x")).select("x.*")
    t = long.groupBy("label").agg(F.sum("gold").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    p = F.coalesce(F.col("hit") / F.nullif(F.col("said"), F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("hit") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    f = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return t.select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


def calibration_error(rows: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """One row: the mean gap of confidence and accuracy over equal-width bins, weighted by their size; 1.0 is in the last bin."""
    at = rows.select(confidence.alias("c"), correct.cast("double").alias("y")).withColumn("bin", F.least(F.floor(F.col("c") * bins), F.lit(bins - 1)))
    each = at.groupBy("bin").agg(F.count("*").alias("n"), F.avg("c").alias("c"), F.avg("y").alias("y"))
    return each.agg(F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("y"))) / F.sum("n"), 6).alias("ece"), F.sum("n").alias("n"))


def _bucketed(rows: DataFrame, key: list[str], value: str, buckets: int = 64) -> DataFrame:
    """``rows`` with ``bucket``: equal values share one, and buckets of a key are in the order of their values.

    Bounds are approximate quantiles of each key, a short array for each; null values have no bucket.
    """
    cuts = F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 4096).alias("_cuts")
    if key:
        rows = rows.join(rows.groupBy(*key).agg(cuts), key)
    else:
        rows = rows.crossJoin(F.broadcast(rows.agg(cuts)))  # one row
    return rows.withColumn("bucket", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def _before(sizes: DataFrame, key: list[str], *counts: str) -> DataFrame:
    """(key, bucket) with the sums of ``counts`` in the buckets before; a few rows for each key."""
    w = Window.partitionBy(*(key or [F.lit(0)])).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*key, "bucket", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before") for c in counts])


def roc_auc(rows: DataFrame, score: Column, positive: Column) -> DataFrame:
    """One row: the share of (positive, negative) pairs in order, ties half, from mean ranks of equal scores.

    Scores are summed up first; running sums go within buckets of scores, and the sums of the lower
    buckets are added, so no task sees all scores.
    """
    c = rows.groupBy(score.alias("s")).agg(F.count_if(positive).cast("double").alias("p"), F.count_if(~positive).cast("double").alias("q"))
    c = _bucketed(c.filter("s is not null"), [], "s")
    lower = _before(c.groupBy("bucket").agg(F.sum("q").alias("q")), [], "q")
    w = Window.partitionBy("bucket").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("q").over(w), F.lit(0.0)) + F.col("q_before")
    at = c.join(F.broadcast(lower), "bucket").withColumn("below", below)  # a row for each bucket
    return at.agg(F.round(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / F.nullif(F.sum("p") * F.sum("q"), F.lit(0.0)), 6).alias("auc"))


def percentiles(rows: DataFrame, key: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """A row for each key: the exact percentile of each name in ``points``, interpolated between its two neighbours.

    Values are ranked within buckets only, and of those only in the few that hold a wanted rank.
    """
    v = _bucketed(rows.select(*key, F.col(value).cast("double").alias("v")).filter("v is not null"), key, "v")
    sizes = v.groupBy(*key, "bucket").agg(F.count("*").alias("n"))
    of = Window.partitionBy(*(key or [F.lit(0)]))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("total") - 1) * p).alias("at")) for name, p in points.items()])
    bounds = _before(sizes, key, "n").join(sizes, [*key, "bucket"]).withColumn("total", F.sum("n").over(of))
    asked = bounds.select(*key, "bucket", "n_before", "n", F.explode(wanted).alias("x")).select("*", "x.*").drop("x")
    here = (F.ceil("at") >= F.col("n_before")) & (F.floor("at") < F.col("n_before") + F.col("n"))
    asked = asked.filter(here).select(*key, "bucket", "n_before", "name", "at")
    ranked = v.join(asked.select(*key, "bucket").distinct(), [*key, "bucket"], "left_semi")
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*key, "bucket").orderBy("v")) - 1)
    near = ranked.join(asked, [*key, "bucket"]).withColumn("r", F.col("r") + F.col("n_before")).filter(F.abs(F.col("r") - F.col("at")) < 1)
    part = F.sum(F.col("v") * (1 - F.abs(F.col("r") - F.col("at")))).alias("v")
    found = near.groupBy(*key, "name").agg(part)
    return found.groupBy(*key).pivot("name", list(points)).agg(F.round(F.first("v"), 6))


def _uniform(*of: Column) -> Column:
    """A number from 0 to 1 by hash, the same on every run and for every partitioning."""
    return F.xxhash64(*of).cast("double") / 2.0**64 + 0.5


def _poisson(uniform: Column) -> Column:
    """The Poisson distribution of mean 1, inverted."""
    weight, below, term = F.lit(0), 0.0, math.exp(-1)
    for k in range(9):
        below += term
        weight = weight + (uniform > below).cast("int")
        term /= k + 1
    return weight


def _resampled(groups: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(b, m): the mean of each resample of groups (k, n, total). Sums per resample combine before the exchange."""
    each = groups.select(F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b"), "k", "n", "total")
    each = each.withColumn("w", _poisson(_uniform(F.col("k"), F.col("b"), F.lit(seed))))
    return each.groupBy("b").agg((F.sum(F.col("w") * F.col("total")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"))


def _with_interval(overall: DataFrame, means: DataFrame) -> DataFrame:
    """One row beside one row: what ``overall`` has, and the 95 % interval of resampled means."""
    ends = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("e"))
    return overall.crossJoin(F.broadcast(ends)).select(*overall.columns, F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))


def bootstrap_mean(rows: DataFrame, key: Column, value: Column, resamples: int = 200, seed: int = 42) -> DataFrame:
    """One row: mean and a 95 % interval of resampled means, by Poisson weights from a hash of key and resample."""
    each = rows.select(key.alias("k"), F.lit(1).alias("n"), value.cast("double").alias("total"))
    return _with_interval(rows.agg(F.avg(value).alias("mean")), _resampled(each, resamples, seed))


def cluster_bootstrap(rows: DataFrame, group: Column, value: Column, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """As ``bootstrap_mean``, but whole groups are resampled: a group of any size becomes one row of sums first."""
    sums = rows.filter(value.isNotNull()).groupBy(group.alias("k")).agg(F.count(value).alias("n"), F.sum(value.cast("double")).alias("total"))
    return _with_interval(rows.agg(F.avg(value).alias("mean")), _resampled(sums, resamples, seed))


def paired(left: DataFrame, right: DataFrame, key: str, value: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """One row: pairs, mean of right - left, its 95 % interval, and the p-value of random flips of sign.

    Only keys with a value on both sides are pairs; without pairs all but ``pairs`` is null.
    """
    both = left.select(key, F.col(value).alias("a")).join(right.select(key, F.col(value).alias("b")), key).filter("a is not null and b is not null")
    gaps = both.select(F.col(key).alias("k"), F.lit(1).alias("n"), (F.col("b") - F.col("a")).cast("double").alias("total"))
    overall = gaps.agg(F.count("*").alias("pairs"), F.avg("total").alias("mean_difference"))
    flips = gaps.select(F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("f"), "k", "total")
    sign = F.when(_uniform(F.col("k"), F.col("f"), F.lit(seed + 1)) < 0.5, 1).otherwise(-1)
    flipped = flips.groupBy("f").agg(F.avg(sign * F.col("total")).alias("m"))
    extreme = flipped.crossJoin(F.broadcast(overall)).agg(F.count_if(F.abs("m") >= F.abs("mean_difference") - 1e-12).alias("extreme"))
    out = _with_interval(overall, _resampled(gaps, resamples, seed)).crossJoin(F.broadcast(extreme))
    return out.select("pairs", "mean_difference", "low", "high", F.when(F.col("pairs") > 0, (F.col("extreme") + 1) / (resamples + 1.0)).alias("p_value"))


def pool(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, pool_hit, pool_recall): what share of the relevant items was found at all; null without relevant items."""
    wanted = qrels.filter("grade > 0").select("query_id", "id").distinct()
    found = ranked.select("query_id", "id", F.lit(1).alias("found")).distinct()
    met = wanted.join(found, ["query_id", "id"], "left").groupBy("query_id").agg(F.max(F.coalesce("found", F.lit(0))).cast("double").alias("pool_hit"), F.round(F.count("found") / F.count("*"), 6).alias("pool_recall"))
    return ranked.select("query_id").union(qrels.select("query_id")).distinct().join(met, "query_id", "left")


def answerability(rows: DataFrame, answerable: Column, answered: Column) -> DataFrame:
    """One row: the four cells of answerable by answered, and the mean of both recalls (null where a side is empty)."""
    cell = lambda a, b: F.count_if((answerable == a) & (answered == b))
    c = rows.agg(cell(True, True).alias("answered"), cell(True, False).alias("missed"), cell(False, False).alias("abstained"), cell(False, True).alias("invented"))
    share = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    return c.withColumn("balanced_accuracy", F.round((share("answered", "missed") + share("abstained", "invented")) / 2, 6))


# --- classification ------------------------------------------------------------------------------


def confusion(rows: DataFrame, gold: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """(by, gold, predicted, n) of each pair that occurs."""
    return rows.groupBy(*(by or []), F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def from_confusion(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row for each ``by`` of (by, gold, predicted, n): n, accuracy, balanced accuracy (mean recall of the labels that occur), macro F1
    (mean over labels that occur or are predicted) and F1 weighted by support."""
    by = by or []
    cells = cells.withColumn("_n", F.coalesce("n", F.lit(0)))
    hit = F.when(F.col("gold") == F.col("predicted"), F.col("_n")).otherwise(0)
    side = lambda c, support: cells.select(*by, F.col(c).alias("label"), (F.col("_n") if support else F.lit(0)).alias("support"), (F.lit(0) if support else F.col("_n")).alias("said"), (hit if support else F.lit(0)).alias("hit"))
    t = side("gold", True).unionByName(side("predicted", False)).groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "said", "hit")]).filter("support + said > 0")
    part = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    f1 = 2 * F.col("hit") / (F.col("support") + F.col("said"))
    out = t.withColumns({"recall": part("hit", "support"), "f1": f1}).groupBy(*by).agg(
        F.sum("support").alias("n"), (F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1")
    )
    return out.select(*by, "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")])


def majority(rows: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """(by, majority, n): the most frequent label; the smallest one wins a tie."""
    by = by or []
    each = rows.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    best = F.struct("n", (-F.col(label)).alias("tie"))
    return each.groupBy(*by).agg(F.max_by(label, best).alias("majority"), F.max("n").alias("n"))


def with_oracle(rows: DataFrame, group: str, label: str) -> DataFrame:
    """``rows`` with ``oracle``: the majority label of the row's group, the best that a function of the group can say."""
    return rows.join(majority(rows, label, [group]).select(group, F.col("majority").alias("oracle")), group, "left")


def by_sentence(rows: DataFrame, sentence: str, gold: str, predicted: str) -> DataFrame:
    """(sentence, gold, predicted, n): the majority label and the majority prediction of each sentence, and its rows."""
    g = majority(rows, gold, [sentence]).select(sentence, F.col("majority").alias("gold"))
    p = majority(rows, predicted, [sentence]).select(sentence, F.col("majority").alias("predicted"))
    return g.join(p, sentence).join(rows.groupBy(sentence).agg(F.count("*").alias("n")), sentence)


def log_loss(rows: DataFrame, probabilities: Column, label: Column) -> DataFrame:
    """One row: mean negative log of the label's probability (labels count from 0); rows of probabilities are brought to a sum of 1."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + x)
    p = F.element_at(probabilities, label.cast("int") + 1) / total
    return rows.agg(F.round(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))), 6).alias("nll"))


def class_counts(rows: DataFrame, label: str, labels: list, by: list[str] | None = None) -> DataFrame:
    """A row for each ``by`` with the rows of each label, 0 where there are none."""
    return rows.groupBy(*(by or [])).agg(*[F.count_if(F.col(label) == x).alias(f"n_{x}") for x in labels])


def class_values(rows: DataFrame, label: str, score: str) -> DataFrame:
    """(label, value): the mean score of each label, to four places."""
    return rows.groupBy(label).agg(F.round(F.avg(score), 4).alias("value"))


def class_weights(rows: DataFrame, labels: list[str], root: bool = False) -> DataFrame:
    """(labels, n, weight): rows divided by labels and their size, or the root of that with ``root``."""
    each = rows.groupBy(*labels).agg(F.count("*").alias("n"))
    total = each.agg(F.sum("n").alias("_total"), F.count("*").alias("_k"))  # one row
    weight = F.col("_total") / (F.col("_k") * F.col("n"))
    return each.crossJoin(F.broadcast(total)).select(*labels, "n", F.round(F.sqrt(weight) if root else weight, 6).alias("weight"))


def constant_baseline(rows: DataFrame, score: str, within: float = 0.15, steps: int = 100) -> DataFrame:
    """(constant, agreement, best): the share of scores within reach of each constant from 0 to 1; the first best one is marked."""
    each = rows.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("_n"))
    grid = rows.sparkSession.range(steps + 1).select((F.col("id") / float(steps)).alias("constant"))
    near = F.sum(F.when(F.abs(F.col("_s") - F.col("constant")) <= within, F.col("_n")).otherwise(0)) / F.sum("_n")
    out = each.crossJoin(F.broadcast(grid)).groupBy("constant").agg(F.round(near, 6).alias("agreement"))  # a short grid
    best = out.agg(F.max_by("constant", F.struct("agreement", -F.col("constant"))).alias("_best"))
    return out.crossJoin(F.broadcast(best)).select("constant", "agreement", (F.col("constant") == F.col("_best")).alias("best"))


def auc_by(rows: DataFrame, by: str, score: str, positive: Column) -> DataFrame:
    """(by, auc, far): ROC-AUC of each group by mean ranks within buckets of its scores, and the share of scores beyond five deviations."""
    r = rows.select(F.col(by).alias("_by"), F.col(score).cast("double").alias("s"), positive.alias("_p"))
    m = r.groupBy("_by").agg(F.avg("s").alias("_m"), F.stddev_pop("s").alias("_d"))
    far = r.join(m, "_by").groupBy("_by").agg(F.round(F.avg((F.abs(F.col("s") - F.col("_m")) > 5 * F.col("_d")).cast("double")), 6).alias("far"))
    c = r.filter("s is not null").groupBy("_by", "s").agg(F.count_if("_p").cast("double").alias("p"), F.count_if(~F.col("_p")).cast("double").alias("q"))
    c = _bucketed(c, ["_by"], "s")
    lower = _before(c.groupBy("_by", "bucket").agg(F.sum("q").alias("q")), ["_by"], "q")
    w = Window.partitionBy("_by", "bucket").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    at = c.join(lower, ["_by", "bucket"]).withColumn("below", F.coalesce(F.sum("q").over(w), F.lit(0.0)) + F.col("q_before"))
    auc = at.groupBy("_by").agg(F.round(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / F.nullif(F.sum("p") * F.sum("q"), F.lit(0.0)), 6).alias("auc"))
    return auc.join(far, "_by").select(F.col("_by").alias(by), "auc", "far")


def standardized(rows: DataFrame, columns: list[str], fit: Column) -> DataFrame:
    """``rows`` with columns less their mean, divided by their population deviation over the rows of ``fit``; a tiny deviation counts as 1."""
    some = rows.filter(fit)
    m = some.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_d_{c}") for c in columns])
    at = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_d_{c}") < 1e-8, 1.0).otherwise(F.col(f"_d_{c}"))
    return rows.crossJoin(F.broadcast(m)).select(*[c for c in rows.columns if c not in columns], *[at(c).alias(c) for c in columns])


def diagnostics(rows: DataFrame, group: str, label: str, score: str, text: str) -> DataFrame:
    """One row about a data set: rows, groups, groups of one row, groups with several labels, mean deviation within larger groups, words."""
    n_words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    g = rows.withColumn("_w", n_words).groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(label).alias("k"), F.stddev_pop(score).alias("d"), F.sum("_w").alias("w"), F.max("_w").alias("longest"))
    return g.agg(
        F.sum("n").alias("n"), F.count("*").alias("groups"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("k") > 1).alias("disagreeing"),
        F.round(F.avg(F.when(F.col("n") > 1, F.col("d"))), 6).alias("deviation_within"), F.round(F.sum("w") / F.sum("n"), 4).alias("mean_words"), F.max("longest").alias("longest"),
    )


def group_codes(rows: DataFrame, group: str, position: str) -> DataFrame:
    """``rows`` with ``code``: groups numbered from 0 by where they first appear. Groups, not rows, are put in order."""
    first = rows.groupBy(group).agg(F.min(position).alias("_at"))
    first = _bucketed(first, [], "_at")
    sizes = _before(first.groupBy("bucket").agg(F.count("*").alias("n")), [], "n")
    code = F.row_number().over(Window.partitionBy("bucket").orderBy("_at", group)) - 1 + F.col("n_before")
    return rows.join(first.join(F.broadcast(sizes), "bucket").select(group, code.cast("bigint").alias("code")), group)


def bootstrap_macro_f1(rows: DataFrame, key: Column, gold: str, predicted: str, resamples: int = 200, seed: int = 42) -> DataFrame:
    """One row: macro F1 and a 95 % interval over resamples of ``key`` (a row, or a sentence with all of its rows)."""
    each = rows.select(key.alias("k"), F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).groupBy("k", "gold", "predicted").agg(F.count("*").alias("c"))
    spread = each.select("*", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b")).withColumn("w", _poisson(_uniform(F.col("k"), F.col("b"), F.lit(seed))))
    cells = spread.groupBy("b", "gold", "predicted").agg(F.sum(F.col("w") * F.col("c")).alias("n")).filter("n > 0")
    whole = from_confusion(confusion(rows, gold, predicted)).select("macro_f1")
    return _with_interval(whole, from_confusion(cells, ["b"]).select(F.col("macro_f1").alias("m")))


# --- retrieval and answers ------------------------------------------------------------------------


def gold_bucket(n: Column) -> Column:
    """How many relevant items a question has, in words."""
    return F.when(n == 0, "none").when(n == 1, "1").when(n <= 3, "2-3").otherwise("4+")


def breakdown(rows: DataFrame, key: Column, values: list[str], name: str = "key") -> DataFrame:
    """(key, n, values): the mean of each value over the rows of each key; nulls do not count."""
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("n"), *[F.round(F.avg(v), 6).alias(v) for v in values])


def arm_summary(rows: DataFrame) -> DataFrame:
    """(arm, n, hit, mrr, pool_hit, recovery): means of each arm; recovery is the share of hits among questions whose pool had a relevant item."""
    s = rows.groupBy("arm").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("hit", "mrr", "pool_hit")])
    return s.select("arm", "n", *[F.round(c, 6).alias(c) for c in ("hit", "mrr", "pool_hit")], F.round(F.col("hit") / F.nullif(F.col("pool_hit"), F.lit(0.0)), 6).alias("recovery"))


def with_total(rows: DataFrame, key: str, values: list[str], categories: tuple[str, list] | None = None) -> DataFrame:
    """(key, n, values): the mean of each value for each key, and for ``all``; with (column, its values), also how many rows of each there are."""
    counts = [F.count_if(F.col(categories[0]) == c).alias(f"n_{c}") for c in categories[1]] if categories else []
    out = rows.rollup(key).agg(F.count("*").alias("n"), F.grouping(key).alias("_all"), *[F.round(F.avg(v), 6).alias(v) for v in values], *counts)
    return out.withColumn(key, F.when(F.col("_all") == 1, "all").otherwise(F.col(key))).drop("_all")


def failures(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` questions, by id, that found nothing."""
    return rows.filter("hit = 0").orderBy("query_id").limit(most)


def grounded(context: DataFrame, qrels: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, grounded, top1, first): whether a relevant source of the context holds an accepted answer, whether the first one does,
    and whether the first source is relevant. Null without accepted answers or relevant items.

    ``context``: query_id, id, place, text; ``qrels``: query_id, id, grade; ``answers``: query_id, form.
    """
    good = context.join(qrels.filter("grade > 0").select("query_id", "id", F.lit(True).alias("relevant")).distinct(), ["query_id", "id"], "left")
    said = good.join(answers, "query_id").withColumn("holds", rules.contains_phrase(F.col("text"), F.col("form")))
    each = said.groupBy("query_id", "id", "place").agg(F.bool_or("holds").alias("holds"), F.bool_or(F.coalesce("relevant", F.lit(False))).alias("relevant"))
    met = each.groupBy("query_id").agg(F.bool_or(F.col("holds") & F.col("relevant")).alias("grounded"), F.bool_or(F.col("holds") & (F.col("place") == 1)).alias("top1"))
    first = good.filter("place = 1").select("query_id", F.coalesce("relevant", F.lit(False)).alias("first"))
    asked = qrels.filter("grade > 0").select("query_id").distinct()
    out = asked.join(met, "query_id", "left").join(first, "query_id", "left").join(answers.select("query_id", F.lit(True).alias("_has")).distinct(), "query_id", "left")
    known = lambda c: F.when(F.col("_has"), F.coalesce(c, F.lit(False)))
    return out.select("query_id", known("grounded").alias("grounded"), known("top1").alias("top1"), F.coalesce("first", F.lit(False)).alias("first"))


def context_quality(context: DataFrame, supporting: DataFrame) -> DataFrame:
    """(query_id, precision, recall) of the sources of a context beside the supporting ones; null where there is nothing to divide by."""
    c, s = context.select("query_id", "id").distinct(), supporting.select("query_id", "id").distinct()
    met = c.join(s, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("m"))
    sizes = [df.groupBy("query_id").agg(F.count("*").alias(n)) for df, n in ((c, "c"), (s, "s"))]
    out = sizes[0].join(sizes[1], "query_id", "full_outer").join(met, "query_id", "left")
    return out.select("query_id", F.round(F.coalesce("m", F.lit(0)) / F.col("c"), 6).alias("precision"), F.round(F.coalesce("m", F.lit(0)) / F.col("s"), 6).alias("recall"))


def leakage(queries: DataFrame, gold: DataFrame, most: int) -> DataFrame:
    """(query_id, share): the share of a question's words that its relevant texts hold, the largest ``most`` of them.

    ``queries``: query_id, text; ``gold``: query_id, text.
    """
    q = queries.select("query_id", rules.tokens(F.col("text")).alias("q"))
    g = gold.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(rules.tokens(F.col("text"))))).alias("g"))
    share = F.size(F.array_intersect("q", "g")) / F.size("q")
    return q.filter("size(q) > 0").join(g, "query_id").select("query_id", F.round(share, 6).alias("share")).orderBy(F.col("share").desc(), "query_id").limit(most)


# --- reports --------------------------------------------------------------------------------------


def flattened(report: dict, prefix: str = "") -> dict[str, float]:
    """The numbers of a nested report by their dotted path."""
    out: dict[str, float] = {}
    for k, v in report.items():
        if isinstance(v, dict):
            out |= flattened(v, f"{prefix}{k}.")
        elif isinstance(v, int | float) and not isinstance(v, bool):
            out[f"{prefix}{k}"] = float(v)
    return out


#: Parts of a key that tell how a report was made, and not what it measured.
NO_METRIC = ("protocol", "provenance", "manifest", "seed", "version", "timestamp", "generated", "n_resamples")


def is_metric(key: Column) -> Column:
    return ~rules.says(key, rf"(?:^|[._]){rules.one_of(*NO_METRIC)}(?:[._]|\z)")


def snapshot_delta(old: DataFrame, new: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, old, new, delta, only): two snapshots side by side; ``only`` names the one that alone has a key."""
    a, b = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    only = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "old")
    return a.join(b, key, "full_outer").select(key, "old", "new", (F.col("new") - F.col("old")).alias("delta"), only.alias("only"))


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(rule, n): how many rows each rule's frame of violations has."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n") for name, df in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
