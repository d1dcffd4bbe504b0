"""How tables meet: none that grows with the corpus goes through the driver because Spark takes it for small."""

from __future__ import annotations

import random

import corpus_pipeline
from engramlake.llm import neardup
from engramlake.llm import text as T
from tests.conftest import SF


def _watched(monkeypatch) -> list[str]:
    """The plans of all tables that are stored from now on; ids are never few enough for a broadcast."""
    plans: list[str] = []

    def stored(df, store=T.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    monkeypatch.setattr(T, "stored", stored)
    monkeypatch.setattr(T, "with_ids", lambda df, ids, how, f=T.with_ids: f(df, ids, how, -1))
    return plans


def test_near_duplicates_are_not_broadcast(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(200)]
        # a chain of texts, each a little further from the first, so links are confirmed between buckets too
        for _ in range(6):
            base = [w if rng.random() > 0.012 else rng.choice(words) for w in base]
            rows.append((len(rows), " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans = _watched(monkeypatch)
    found = neardup.near_duplicates(docs)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == neardup.brute_force(rows, neardup.SHINGLE, neardup.THRESHOLD)
    plans.clear()
    kept = neardup.deduplicate(docs)
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    assert not any("Broadcast" in p for p in plans)


def test_pipeline_stages_are_not_broadcast(spark, monkeypatch):
    plans = _watched(monkeypatch)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = T.stored(stage(spark, docs, SF))
    assert not any("Broadcast" in p for p in plans)
