"""Whole evaluations as batches: retrieval arms over a table of questions, their comparison, retention by replay, labelled sentences."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.operators import ingest, metrics, search


@dataclass(frozen=True)
class Arm:
    """A way to search: which channels it has, and whether it reranks and orders by structure."""

    name: str
    semantic: bool = True
    graph: bool = True
    rerank: bool = True


#: The arms, and which pairs of them are compared.
ARMS = (Arm("keyword", False, False, False), Arm("semantic_keyword", True, False, False), Arm("fusion", True, True, False), Arm("reranked", True, False, True), Arm("full", True, True, True))
COMPARISONS = (("keyword", "fusion"), ("semantic_keyword", "fusion"), ("fusion", "full"), ("reranked", "full"))


def run_arms(queries: DataFrame, records: DataFrame, qrels: DataFrame, now: Column, limit: int = 5, chunks: DataFrame | None = None, graph: tuple | None = None, scorer: search.Scorer | None = None, arms: tuple[Arm, ...] = ARMS) -> DataFrame:
    """(arm, query_id, recall, hit, mrr, ndcg) of each arm and question; an arm goes without what is not given."""
    parts = []
    for arm in arms:
        asked = queries if arm.semantic or "vector" not in queries.columns else queries.drop("vector")
        hits = search.hybrid(asked, records, now, limit, chunks, graph if arm.graph else None, scorer if arm.rerank else None)
        parts.append(metrics.ranking(hits.select("query_id", "id", "rank"), qrels, limit).select(F.lit(arm.name).alias("arm"), "*"))
    return reduce(DataFrame.unionByName, parts)


def compared(results: DataFrame, value: str, pairs: tuple[tuple[str, str], ...] = COMPARISONS, resamples: int = 1000) -> DataFrame:
    """(left, right, pairs, mean_difference, low, high, p_value) of each pair of arms that both ran."""
    known = {r["arm"] for r in results.select("arm").distinct().collect()}  # a few names
    parts = []
    for a, b in pairs:
        if {a, b} <= known:
            one, two = (results.filter(F.col("arm") == x).select("query_id", value) for x in (a, b))
            parts.append(metrics.paired(one, two, "query_id", value, resamples).select(F.lit(a).alias("left"), F.lit(b).alias("right"), "*"))
    return reduce(DataFrame.unionByName, parts)


def retained(states: DataFrame, records: DataFrame, gold: DataFrame, asked_at: Column) -> DataFrame:
    """(group, n, retained): of the records that a question needs (gold: id, group), the share that can still be seen when it is asked.

    ``states``: of ``reconcile.reconciled``. A statement that was joined to another one is seen as its evidence.
    """
    fresh = records.filter(F.col("expires_at").isNull() | (F.col("expires_at") > asked_at)).select("id")
    active = states.filter("status = 'active'").join(fresh, "id", "left_semi").select("id")
    joined = states.filter("status = 'consolidated'").join(active.select(F.col("id").alias("consolidated_into")), "consolidated_into", "left_semi").select("id")
    seen = active.union(joined).distinct().withColumn("seen", F.lit(1.0))
    return gold.join(seen, "id", "left").groupBy("group").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("seen", F.lit(0.0))), 6).alias("retained"))


def replayed(messages: DataFrame, now: Column) -> DataFrame:
    """(role, n, visible): messages of a history taken in one by one, and the share of each role that is seen at ``now``."""
    r = ingest.process(messages, F.col("created_at"))
    seen = (F.col("expires_at").isNull() | (F.col("expires_at") > now)) & F.col("problem").isNull()
    return r.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(seen.cast("double")), 6).alias("visible"))


def classification(cases: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(a row for each category, one row in all) of labelled sentences (content, expected_category)."""
    m = cases.withColumns({"user_id": F.lit("u"), "session_id": F.lit("s"), "created_at": now})
    r = ingest.process(m, now).select(F.col("expected_category").alias("gold"), F.col("category").alias("predicted"))
    return metrics.by_class(r, "gold", "predicted"), metrics.from_confusion(metrics.confusion(r, "gold", "predicted"))


def summary_lines(rows: DataFrame, columns: list[str]) -> list[str]:
    """A report's table as lines of text, all of its rows; they come to the driver a partition at a time."""
    found = ([str(r[c]) for c in columns] for r in rows.select(*columns).toLocalIterator())
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(r) + " |" for r in found)]


def lifecycle_checks(states: DataFrame, wanted: DataFrame, key: str, column: str) -> DataFrame:
    """(key, wanted, found) where a state is not what it should be; empty where all is well."""
    both = wanted.select(key, F.col(column).alias("wanted")).join(states.select(key, F.col(column).alias("found")), key, "left")
    return both.filter(~F.col("wanted").eqNullSafe(F.col("found")))


