"""How many of the exact nearest vectors the approximate search finds."""

from __future__ import annotations

import __spark_entry__
from tests.conftest import SF


def test_lsh_recall(spark):
    best = lambda name: {(r.query_id, r.id) for r in __spark_entry__.queries()[name](spark, SF).collect()}
    exact = best("vector_topk")
    assert len(exact & best("lsh_topk")) >= 0.9 * len(exact)
