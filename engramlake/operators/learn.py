"""Fitting what an importance model needs around it: splits, temperature, blend and class weights; probabilities as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.operators import metrics

#: Classes of importance by their lower edges, bounds of a temperature, and the grid of class weights.
EDGES = (0.4, 0.7)
TEMPERATURES = (0.25, 10.0)
WEIGHTS = (0.5, 0.625, 0.75, 0.875, 1.0, 1.25, 1.5, 1.75, 2.0)
PINNED_SHARE = 0.05


def score_class(score: Column) -> Column:
    """0, 1 or 2: below the first edge, below the second one, or from there on."""
    return F.when(score < EDGES[0], 0).when(score < EDGES[1], 1).otherwise(2)


def split(rows: DataFrame, group: str, label: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """``rows`` with ``split``: whole groups go to one split, in the given shares for each majority label; a group with a
    twentieth of all rows or more goes to the first one.

    Groups of a label are placed by a hash, each where its hash falls among the shares, so no group depends on another.
    """
    total = rows.count()
    g = metrics.majority(rows, label, [group]).select(group, F.col("majority").alias("_label")).join(rows.groupBy(group).agg(F.count("*").alias("_n")), group, "right")
    place = F.pmod(F.xxhash64(F.col(group), F.coalesce(F.col("_label").cast("string"), F.lit("")), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    names, upto, out = list(shares), 0.0, None
    for name in names[:-1]:
        upto += shares[name]
        out = F.when(place < upto, name) if out is None else out.when(place < upto, name)
    out = F.lit(names[0]) if out is None else out.otherwise(names[-1])
    chosen = F.when(F.col("_n") >= PINNED_SHARE * total, names[0]).otherwise(out)
    return rows.join(g.select(group, chosen.alias("split")), group)


def split_problems(rows: DataFrame, group: str, id_column: str) -> DataFrame:
    """(problem, n): rows without a split, rows twice, and groups in more than one split."""
    return metrics.violations({
        "no_split": rows.filter("split is null"), "repeated": rows.groupBy(id_column).count().filter("count > 1"), "torn_group": rows.groupBy(group).agg(F.count_distinct("split").alias("k")).filter("k > 1"),
    }).withColumnRenamed("rule", "problem")


def log_probabilities(p: Column) -> Column:
    return F.transform(p, lambda x: F.log(F.greatest(x, F.lit(1e-12))))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    t = F.lit(temperature) if isinstance(temperature, int | float) else temperature
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def mean_probabilities(models: list[Column]) -> Column:
    """The mean of several models' probabilities."""
    n = float(len(models))
    total = models[0]
    for m in models[1:]:
        total = F.zip_with(total, m, lambda a, b: a + b)
    return F.transform(total, lambda x: x / n)


def blend(a: Column, b: Column, weight: Column | float) -> Column:
    """``weight`` parts of ``a`` and the rest of ``b``."""
    w = F.lit(weight) if isinstance(weight, int | float) else weight
    return F.zip_with(a, b, lambda x, y: w * x + (1 - w) * y)


def weighted_class(p: Column, weights: list[float] | Column) -> Column:
    """The class with the largest weighted probability; the first one wins a tie."""
    w = F.array(*map(F.lit, weights)) if isinstance(weights, list) else weights
    s = F.zip_with(p, w, lambda x, y: x * y)
    return F.array_position(s, F.array_max(s)).cast("int") - 1


def _mean_loss(rows: DataFrame, ts: list[float]) -> list[float]:
    """Mean negative log-likelihood at several temperatures, in one pass."""
    loss = lambda t: F.avg(-F.log(F.greatest(F.element_at(softmax(F.col("logits"), t), F.col("label").cast("int") + 1), F.lit(1e-12))))
    return [float(x) if x is not None else 0.0 for x in rows.agg(*[loss(t).alias(f"l{i}") for i, t in enumerate(ts)]).first()]


def fit_temperature(rows: DataFrame, rounds: int = 4, points: int = 9) -> float:
    """The temperature of least loss on ``rows`` (logits, label): a grid of logarithms that narrows around its best point."""
    lo, hi = (math.log(t) for t in TEMPERATURES)
    best = 0.0
    for _ in range(rounds):
        grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
        losses = _mean_loss(rows, [math.exp(g) for g in grid])
        best = grid[losses.index(min(losses))]
        step = (hi - lo) / (points - 1)
        lo, hi = max(lo, best - step), min(hi, best + step)
    return math.exp(best)


def blend_grid(rows: DataFrame, steps: int = 20) -> DataFrame:
    """(weight, macro_f1, nll, best) of blends of ``a`` and ``b`` (probabilities) on ``rows`` with a label; more F1, then less loss, then
    the weight nearest to one half is best."""
    grid = rows.sparkSession.range(steps + 1).select((F.col("id") / float(steps)).alias("weight"))
    each = rows.crossJoin(F.broadcast(grid)).withColumn("p", blend(F.col("a"), F.col("b"), F.col("weight")))  # a short grid
    each = each.withColumns({"said": weighted_class(F.col("p"), F.transform(F.col("p"), lambda x: F.lit(1.0))), "loss": -F.log(F.greatest(F.element_at("p", F.col("label").cast("int") + 1), F.lit(1e-12)))})
    f1 = metrics.from_confusion(metrics.confusion(each, "label", "said", ["weight"]), ["weight"]).select("weight", "macro_f1")
    out = f1.join(each.groupBy("weight").agg(F.round(F.avg("loss"), 6).alias("nll")), "weight")
    best = out.agg(F.max_by("weight", F.struct("macro_f1", -F.col("nll"), -F.abs(F.col("weight") - 0.5))).alias("_b"))
    return out.crossJoin(F.broadcast(best)).select("weight", "macro_f1", "nll", (F.col("weight") == F.col("_b")).alias("best"))


def class_weight_grid(rows: DataFrame) -> DataFrame:
    """(first, last, macro_f1, accuracy, best) for weights of the first and last class beside 1 for the middle one, on ``rows`` (p, label).

    More macro F1 is best, then more accuracy, then weights nearest to 1.
    """
    spark = rows.sparkSession
    grid = spark.createDataFrame([(a, b) for a in WEIGHTS for b in WEIGHTS], "first double, last double")
    each = rows.crossJoin(F.broadcast(grid))  # 81 rows
    each = each.withColumn("said", weighted_class(F.col("p"), F.array("first", F.lit(1.0), "last")))
    out = metrics.from_confusion(metrics.confusion(each, "label", "said", ["first", "last"]), ["first", "last"]).select("first", "last", "macro_f1", "accuracy")
    away = -(F.abs(F.log("first")) + F.abs(F.log("last")))
    best = out.agg(F.max_by(F.struct("first", "last"), F.struct("macro_f1", "accuracy", away, -F.col("first"))).alias("_b"))
    return out.crossJoin(F.broadcast(best)).select("first", "last", "macro_f1", "accuracy", ((F.col("first") == F.col("_b.first")) & (F.col("last") == F.col("_b.last"))).alias("best"))


def model_inputs(rows: DataFrame, text: str, slots: int = 512) -> DataFrame:
    """``rows`` with ``lexical``: for each hash slot of a text's words, in order of slots, log(1 + its words), as (slot, value)."""
    from engramlake.functions import rules

    at = F.transform(rules.words(F.col(text)), lambda w: rules.lexical_slot(w, slots))
    each = F.transform(F.array_sort(F.array_distinct(at)), lambda s: F.struct(s.alias("slot"), F.round(F.log1p(F.size(F.filter(at, lambda x: x == s))), 6).alias("value")))
    return rows.withColumn("lexical", each)
