"""The engine over its log: revisions of what changed, of the users of a batch alone."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from engramlake.engine import Engine
from engramlake.plans.registry import at
from engramlake.sources.files import Conflict

NOW = "2026-09-26 12:00:00"


def said(spark, *of):
    m = spark.createDataFrame(list(of), "id string, user_id string, content string, t string")
    return m.withColumns({"session_id": F.lit("s"), "created_at": F.col("t").cast("timestamp_ntz")}).drop("t")


def test_only_what_changes_gets_a_revision(spark, monkeypatch):
    e = Engine(spark)
    first = e.ingest(said(spark, ("a#1", "ann", "I live in Chennai.", "2026-09-01 10:00:00"), ("a#2", "ann", "Pay the phone bill on 2026-09-28", "2026-09-02 10:00:00"), ("b#1", "bob", "My favorite book is Dune.", "2026-09-03 10:00:00")), at(NOW))
    assert {r.id for r in first.collect()} == {"a#1", "a#2", "b#1"}
    due = e.get("a#2").first()["due"]
    second = e.ingest(said(spark, ("a#3", "ann", "I live in Bengaluru.", "2026-09-10 10:00:00"), ("a#4", "ann", "Postpone the phone bill by 2 days", "2026-09-11 10:00:00"), ("b#1", "ann", "Not mine", "2026-09-12 10:00:00")), at(NOW))
    assert {r.id for r in second.collect()} == {"a#1", "a#2", "a#3", "a#4"}  # nothing of bob's, and not his id
    state = {r.id: r for r in e.log.collect()}
    assert (state["a#1"].memory_status, state["a#1"].superseded_by, state["a#3"].memory_status) == ("superseded", "a#3", "active")
    assert (state["a#2"].due - due).days == 2
    assert state["b#1"].user_id == "bob"
    assert [(r.memory_status, r.revision) for r in e.history("a#1").orderBy("revision").collect()] == [("active", 1), ("superseded", 2)]
    # the same again changes nothing, and no task moves twice
    assert e.ingest(said(spark, ("a#4", "ann", "Postpone the phone bill by 2 days", "2026-09-11 10:00:00")), at(NOW)).count() == 0
    assert (e.get("a#2").first()["due"] - due).days == 2
    head = e.commits.head()
    monkeypatch.setattr(e.commits, "head", lambda: head - 1)  # as another writer sees it that began before
    with pytest.raises(Conflict):
        e.ingest(said(spark, ("b#2", "bob", "I like tea.", "2026-09-20 10:00:00")), at(NOW))
    monkeypatch.undo()
    assert e.commits.head() == head
    e.forget("ann")
    assert {r.user_id for r in e.revisions().collect()} == {"bob"}
