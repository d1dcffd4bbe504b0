"""The committed log, tables in parts, the approximate index, and operators over string ids."""

from __future__ import annotations

import glob
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramlake.operators import ann, evaluate, graph, reconcile, retrieval, vectors
from engramlake.sources.commits import CommitLog
from engramlake.sources.files import Conflict
from engramlake.sources.parts import Keyed


@pytest.fixture
def root(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


def rows(spark, *of):
    return spark.createDataFrame(list(of), "id string, user_id string, text string")


def test_of_two_appends_at_once_one_fails_cleanly(spark, root):
    a, b = CommitLog(spark, root, buckets=4), CommitLog(spark, root, buckets=4)
    assert a.append(rows(spark, ("m#1", "u", "x"))) == 1
    head = b.head()
    assert a.append(rows(spark, ("m#2", "v", "y"))) == 2
    before = sorted(glob.glob(f"{root}/data/*"))
    with pytest.raises(Conflict):
        b.append(rows(spark, ("m#3", "w", "z")), head=head)
    assert sorted(glob.glob(f"{root}/data/*")) == before  # nothing of it is left
    assert b.append(rows(spark, ("m#1", "u", "xx"))) == 3
    assert {(r.id, r.text) for r in a.current().collect()} == {("m#1", "xx"), ("m#2", "y")}
    assert [(r.text, r.revision) for r in a.history("m#1").orderBy("revision").collect()] == [("x", 1), ("xx", 2)]
    assert {r.text for r in a.current(upto=2).collect()} == {"x", "y"}


def test_a_read_of_some_users_opens_their_folders_alone(spark, root):
    log = CommitLog(spark, root, buckets=16)
    log.append(rows(spark, *[(f"m{i}", f"u{i}", "t") for i in range(40)]))
    one = log.revisions(users=spark.createDataFrame([("u7",)], "user_id string"))
    assert [r.id for r in one.collect()] == ["m7"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan.split("PartitionFilters")[1][:200]


def test_compaction_and_removal_keep_what_was_read(spark, root):
    log = CommitLog(spark, root, buckets=4)
    for k in range(3):
        log.append(rows(spark, ("a", "u", f"t{k}"), (f"b{k}", None, "n")))
    want = sorted(map(str, log.revisions().collect()))
    log.compact()
    assert sorted(map(str, log.revisions().collect())) == want
    assert len(log.commits()) == 1
    assert log.append(rows(spark, ("a", "u", "t9")).withColumn("more", F.lit(1))) == 5
    assert {(r.id, r.text, r.more) for r in log.current().collect()} == {("a", "t9", 1), ("b0", "n", None), ("b1", "n", None), ("b2", "n", None)}
    log.replace(log.revisions().filter("user_id is null"), log.head())
    assert {r.id for r in log.current().collect()} == {"b0", "b1", "b2"}
    assert log.revisions(upto=3).count() == 6
    empty = CommitLog(spark, root + "-none")
    assert empty.head() == 0
    assert empty.revisions(schema=rows(spark, ("a", "u", "t")).schema).count() == 0


def changes(spark, *of):
    return spark.createDataFrame(list(of), "key string, version bigint, deleted boolean, value int")


def test_tables_in_parts_take_each_change_once(spark, root):
    t = Keyed(spark, root, parts=8)
    t.merge(changes(spark, *[(f"k{i}", 5, False, i) for i in range(60)], ("k1", 7, False, 100), ("k1", 6, False, 50)), 0)
    files = lambda: set(glob.glob(f"{root}/data/*/*/*.parquet"))
    of = lambda: {p for load in t.table.manifest().parts.items() for p in glob.glob(f"{root}/data/load={load[1]}/part={load[0]}/*")}
    before, live = files(), of()
    assert t.merge(changes(spark, ("k1", 6, False, 1), ("k2", 4, True, None)), 1) == []  # late
    assert t.merge(changes(spark, ("k3", 9, False, 1)), 1) == []  # a repeat of the number
    assert files() == before
    touched = t.merge(changes(spark, ("k3", 9, True, None), ("new", 1, False, 7)), 2)
    assert 1 <= len(touched) <= 2
    assert len(of() & live) >= len(live) - 2  # the other parts keep their files
    assert t.merge(changes(spark, ("k3", 8, False, 3)), 3) == []  # what is deleted stays so
    got = {r.key: (r.version, r.value) for r in t.rows().collect()}
    assert got == {f"k{i}": (5, i) for i in range(60) if i not in (1, 3)} | {"k1": (7, 100), "new": (1, 7)}


def made(n: int, seed: int = 1) -> np.ndarray:
    x = np.random.default_rng(seed).normal(size=(n, 24))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, x: np.ndarray, of=lambda i: f"v{i}"):
    return spark.createDataFrame([(of(i), v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>").repartition(4)


def test_index_recall_holds_while_the_share_falls(spark, root):
    shares = []
    for n in (400, 2000, 10_000):
        x = made(n)
        x[: n // 3] = x[0]  # a hot vector
        base = table(spark, x)
        index = ann.VectorIndex(spark, f"{root}/{n}")
        assert index.sync(base) == "built"
        asked = [i for i in range(0, n, max(20, n // 100)) if i >= n // 3]
        q = base.filter(F.col("id").isin([f"v{i}" for i in asked])).withColumnRenamed("id", "query_id")
        found = index.search(q, 10, exact_rows=0).collect()
        s = np.round(x[asked] @ x.T, 6)
        s[np.arange(len(asked)), asked] = -9
        edge = np.sort(s, axis=1)[:, -10]
        hit = sum(r.score >= edge[asked.index(int(r.query_id[1:]))] for r in found)
        assert hit >= 0.9 * 10 * len(asked)
        assert max(r["rank"] for r in found) == 10
        shares.append(sum({r.query_id: r.looked_at for r in found}.values()) / len(asked) / n)
    assert shares[0] > shares[1] > shares[2]


def test_index_upkeep(spark, root):
    x = made(600)
    index = ann.VectorIndex(spark, root)
    assert index.sync(table(spark, x)) == "built"
    assert index.sync(table(spark, x)) == "reused"
    parts = dict(index.parts.manifest().parts)
    x[5] = -x[5]
    assert index.sync(table(spark, np.concatenate([x, made(1, 9)]))) == "updated"
    now = index.parts.manifest()
    assert sum(parts[k] == v for k, v in now.parts.items() if k in parts) >= len(parts) - 3
    assert sum(now.meta["counts"]) == index.parts.read().count() == 601
    exact = vectors.top_k(table(spark, x[5:6], lambda i: "q").withColumnRenamed("id", "query_id"), table(spark, np.concatenate([x, made(1, 9)])), 5).collect()
    q = table(spark, x[5:6], lambda i: "q").withColumnRenamed("id", "query_id")
    assert [r.id for r in index.search(q, 5).orderBy("rank").collect()] == [r.id for r in sorted(exact, key=lambda r: r["rank"])]  # small tables are exact
    assert ann.VectorIndex(spark, root, cells=7).sync(table(spark, x)) == "built"  # other parameters
    none = ann.VectorIndex(spark, f"{root}-none")
    assert none.sync(table(spark, x).limit(0)) == "built"
    assert none.search(q, 3).count() == 0


def test_index_of_owners(spark, root):
    x = made(900, 3)
    base = table(spark, x).withColumn("owner", F.when(F.substring("id", 2, 9).cast("int") < 30, "few").otherwise("many"))
    index = ann.VectorIndex(spark, root)
    index.sync(base)
    q = base.filter("id in ('v3', 'v40')").withColumnRenamed("id", "query_id")
    got = index.search(q, 5, exact_rows=0).collect()
    assert {(r.query_id, r.path) for r in got} >= {("v3", "exact")}
    own = lambda i: int(i[1:]) < 30
    assert len(got) == 10
    assert all(own(r.id) == own(r.query_id) for r in got)


def test_string_ids_pass_through(spark):
    texts = spark.createDataFrame([("m1#1", "the red house"), ("m1#2", "a red car and a house"), ("m2", None)], "id string, text string")
    q = spark.createDataFrame([("q#1", "red house")], "query_id string, text string")
    got = [(r.query_id, r.id, r["rank"]) for r in retrieval.keyword_hits(q, texts, 5).orderBy("rank").collect()]
    assert got == [("q#1", "m1#1", 1), ("q#1", "m1#2", 2)]
    cut = retrieval.chunks(texts)
    assert {r.chunk_id for r in cut.collect()} == {"m1#1:0", "m1#2:0"}
    v = spark.createDataFrame([("a#1", [1.0, 0.0]), ("a#2", [0.6, 0.8]), ("b", [0.0, 1.0])], "id string, vector array<double>")
    near = vectors.top_k(v.withColumnRenamed("id", "query_id"), v, 1)
    assert {(r.query_id, r.id) for r in near.collect()} == {("a#1", "a#2"), ("a#2", "b"), ("b", "a#2")}
    assert vectors.lsh_top_k(v.withColumnRenamed("id", "query_id"), v, 1, vectors.Planes(2, 4, 2), 2).count() == 3
    assert vectors.lsh_top_k(v.withColumnRenamed("id", "query_id").limit(0), v.limit(0), 1, vectors.Planes(2), 1).count() == 0
    s = spark.createDataFrame([("u", "k", "a#2", 1, 0.5, 3, 0.0), ("u", "k", "a#1", 1, 0.5, 3, 0.0), ("u", "k", "z", 0, 0.9, 9, 1.0)], "user string, key string, id string, source_priority int, confidence double, observed_at int, importance double")
    assert [tuple(r) for r in reconcile.support(s, ["user", "key"]).collect()] == [("u", "k", "a#1", 3)]


def test_classes_expand_to_the_pairs(spark):
    rng = np.random.default_rng(2)
    said = [("u", "s", f"p{rng.integers(3)}", f"m{i}", None if i % 17 == 0 else f"v{rng.integers(3)}", bool(rng.integers(2)), bool(rng.integers(2))) for i in range(120)]
    r = spark.createDataFrame(said, "user_id string, subject string, predicate string, id string, value string, positive boolean, exclusive boolean")
    classes, members, links = reconcile.contradiction_classes(r)
    want = {(x.left_id, x.right_id) for x in reconcile.contradictions(r).collect()}
    got = [(x.left_id, x.right_id) for x in reconcile.expanded(members, links).collect()]
    assert len(got) == len(set(got)) == sum(x.n_pairs for x in links.collect())
    assert set(got) == want
    hot = spark.range(20_000).select(F.lit("u").alias("user_id"), F.lit("s").alias("subject"), F.lit("home").alias("predicate"), "id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("value"), F.lit(True).alias("positive"), F.lit(True).alias("exclusive"))
    c, _, l = reconcile.contradiction_classes(hot)
    assert c.count() == 2
    assert [x.n_pairs for x in l.collect()] == [100_000_000]


def test_paths_of_a_group_are_cut_together(spark):
    edges = spark.createDataFrame([(f"e{i:03d}", f"n{i // 3}", f"n{i + 1}", True) for i in range(60)], "id string, subject string, object string, positive boolean")
    seeds = spark.createDataFrame([("g", "n0"), ("g", "n1"), ("h", "n2")], "group string, node string")
    whole = graph.paths(edges, seeds, 3).collect()
    for most in (1, 4, 9, 50):
        want = []
        for g in ("g", "h"):
            want += sorted([(r.group, r.hop, r.edges, r.seed) for r in whole if r.group == g], key=lambda x: (x[1], x[2], x[3]))[:most]
        got = [(r.group, r.hop, r.edges, r.seed) for r in graph.paths(edges, seeds, 3, most=most).collect()]
        assert sorted(got) == sorted(want)


def test_a_report_has_all_rows(spark):
    assert len(evaluate.summary_lines(spark.range(2500), ["id"])) == 2502


@pytest.mark.parametrize("batches", [1, 3])
def test_reconciliation_as_a_stream_gives_the_states_of_the_batch_run(spark, root, batches):
    from engramlake.plans.stream_queries import _stated
    from engramlake.streaming import ingest

    rng = np.random.default_rng(6)
    events = spark.createDataFrame([(i, int(rng.integers(3)), "abc"[rng.integers(3)]) for i in range(120)], "event_id bigint, user_id bigint, event_type string")
    stated = _stated(events).withColumn("source_priority", (F.col("position") % 3).cast("double"))  # some win against newer ones
    for k in range(batches):
        stated.filter((F.col("position") * batches / 120).cast("int") == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    late = stated.filter("position = 5").withColumn("id", F.lit("late"))
    late.coalesce(1).write.mode("append").parquet(f"{root}/in")
    sent = spark.readStream.schema(stated.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    got = {r.id: r.asDict() for r in ingest.newest(ingest.land(ingest.reconciled(sent), "update", root), "id", "turn").collect()}
    assert got.pop("late")["status"] == "late"
    want = {r.id: r.asDict() for r in reconcile.reconciled(stated, "position").collect()}
    assert {i: {k: r[k] for k in want[i]} for i, r in got.items()} == want


def test_a_stream_keeps_a_table_up(spark, root):
    from engramlake.streaming import ingest

    for part in ([("k1", 1, "a"), ("k1", 2, "b"), ("k2", 5, "c")], [("k1", 1, "late"), ("k3", 1, "d")]):
        spark.createDataFrame(part, "key string, version bigint, digest string").coalesce(1).write.mode("append").parquet(f"{root}/in")
    t = Keyed(spark, f"{root}/table", parts=4)
    sent = spark.readStream.schema("key string, version bigint, digest string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    for _ in range(2):  # started again it has nothing to do
        ingest.refreshed(sent, t, f"{root}/progress").awaitTermination()
    assert {(r.key, r.digest) for r in t.rows().collect()} == {("k1", "b"), ("k2", "c"), ("k3", "d")}


def test_long_chains_are_reached_in_few_rounds(spark, monkeypatch):
    made = []
    keep = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: made.append(1) or keep(df))
    n = 3000
    pairs = [(i, i + 1) for i in range(n)] + [(700, 50_000), (50_000, 50_001), (50_001, 50_002), (50_002, 50_000), (60_000, 60_001), (-5, 10)] + [(70_000 + i, 70_001 + i) for i in range(40)] + [(n, 70_020)]
    links = spark.createDataFrame(pairs, "src bigint, dst bigint")
    got = {r.id for r in graph.reachable(links, spark.createDataFrame([(5,), (99,)], "id bigint")).collect()}
    assert got == set(range(5, n + 1)) | {50_000, 50_001, 50_002, 99} | set(range(70_020, 70_041))
    assert len(made) <= 100
