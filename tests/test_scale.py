"""What steps make where tables are large: rows of pairs, memory of workers, columns that are read."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from engramlake.functions import claims, rules, tasks
from engramlake.operators import ann, graph, reconcile, retrieval, vectors
from engramlake.plans import graph_queries, stream_queries
from engramlake.streaming import ingest
from tests.conftest import SF


def test_prefixes_take_rare_words_first():
    rng = np.random.default_rng(5)
    words = rng.integers(-(2**63), 2**63 - 1, 60_000)
    sets = [np.unique(words[(rng.random(n) ** 4 * len(words)).astype(int)]) for n in (1, 3, 40, 200, 1500)]
    counts = np.zeros(reconcile.CELLS, np.int64)
    np.add.at(counts, (np.concatenate(sets) >> 40) & (reconcile.CELLS - 1), 1)
    row, n, place, h, sketch = reconcile._prefixes(pa.array([s.tolist() for s in sets], pa.list_(pa.int64())), counts, 0.75)
    for i, s in enumerate(sets):
        c = counts[(s >> 40) & (reconcile.CELLS - 1)]
        assert h[row == i].tolist() == s[np.lexsort((s, c))][: len(s) - int(np.ceil(0.75 * len(s))) + 1].tolist()
        for j, other in enumerate(sets):
            assert np.bitwise_count((sketch[i] ^ sketch[j]).view(np.uint64)).sum() <= len(np.setxor1d(s, other))


def test_similar_pairs_are_whole(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.choice(3000, rng.integers(1, 60))) for _ in range(120)]
    texts += [" ".join(w for w in t.split() if rng.random() > 0.12) for t in texts]
    sets = {i: frozenset(t.split()) for i, t in enumerate(texts)}
    first = {s: min(i for i in sets if sets[i] == s) for s in sets.values() if s}
    want = {(a, b) for x, a in first.items() for y, b in first.items() if a < b and round(len(x & y) / len(x | y), 6) >= 0.75}
    got = reconcile.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    assert {(r.left_id, r.right_id) for r in got.collect()} == want and want


def _best(q_ids, q, ids, x, k, least, may=None):
    s = np.round(q @ x.T, 6)
    ok = (q_ids[:, None] != ids[None, :]) & (s >= least)
    ok &= True if may is None else may
    return [(int(q_ids[i]), int(ids[j]), s[i, j]) for i in range(len(q)) for j in sorted(np.flatnonzero(ok[i]), key=lambda j: (-s[i, j], ids[j]))[:k]]


def test_nearest_in_tiles():
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(20_000, 8)), 1)  # with ties
    ids, q_of, x_of = rng.permutation(20_000), np.zeros(300, np.int64), np.zeros(20_000, np.int64)
    q, q_ids, planes = x[:300], ids[:300], vectors.Planes(8, tables=2, bits=6)
    tracemalloc.start()
    got = vectors._nearest(q_ids, q, q_of, ids, x, x_of, 10, 3.0, 6).to_pylist()
    assert tracemalloc.get_traced_memory()[1] < 120e6  # all scores of 300 queries are 48 MB, and took four times as much
    tracemalloc.stop()
    assert [tuple(r.values()) for r in got] == _best(q_ids, q, ids, x, 10, 3.0)
    (a, _), (b, _) = planes.signatures(q), planes.signatures(x)
    probed = (np.bitwise_count(a[:, None] ^ b[None]) <= 1).any(2)
    got = vectors._nearest(q_ids, q, q_of, ids, x, x_of, 10, -1.0, 6, planes, 1).to_pylist()
    assert [tuple(r.values()) for r in got] == _best(q_ids, q, ids, x, 10, -1.0, probed)


def test_queries_meet_rows_some_at_a_time(monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(retrieval, "MET", 500)
    asked = [(i, [f"w{x}" for x in rng.choice(40, rng.integers(1, 9), replace=False)], "u" if i % 3 else "v") for i in range(50)]
    rows = [[f"w{x}" for x in rng.choice(60, rng.integers(0, 25), replace=False)] for _ in range(300)]
    owners = ["v" if i % 2 else "u" for i in range(300)]
    parts = list(retrieval._Asked(asked, "bigint").pairs(pa.array(rows, pa.list_(pa.string())), pa.array(owners)))
    assert len(parts) > 20 and max(s.sum() for _, _, s in parts) <= 500 + 9 * 50 * 25
    got = sorted((int(q), int(r), int(s)) for part in parts for q, r, s in zip(*part, strict=True))
    assert got == sorted((q, r, n) for q, t, o in asked for r, words in enumerate(rows) if o == owners[r] and (n := len({*t} & {*words})))


def test_texts_in_parts_of_bytes(monkeypatch):
    monkeypatch.setattr(retrieval, "TEXT_BYTES", 100)
    b = pa.RecordBatch.from_pydict({"id": list(range(8)), "text": ["x" * n if n is not None else None for n in (30, 60, 10, 1, 500, None, 0, 99)]})
    parts = list(retrieval._parts(b, "text"))
    assert [p.column("id").to_pylist() for p in parts] == [[0, 1, 2], [3], [4], [5, 6, 7]]


def test_mentions_join_one_word_of_an_alias(spark):
    texts = spark.createDataFrame([(1, "An MIT license; licence MIT License"), (2, "license by MIT"), (3, None), (4, "the other"), (5, "")], "id int, text string")
    names = spark.createDataFrame([(1, "MIT License"), (2, "the"), (3, "other thing"), (4, "--")], "node_id int, alias string")
    found = graph.mentions(texts, names, "id", "text")
    assert sorted((r.id, r.node_id) for r in found.collect()) == [(1, 1), (4, 2)]
    assert "transform" not in found._jdf.queryExecution().analyzed().toString()  # no string is made for each run of words


def test_links_are_read_as_they_are(spark):
    assert "Aggregate" not in graph_queries.references(spark, SF)._jdf.queryExecution().analyzed().toString()  # not all links are shuffled for each round
    chain = [(f"a{i}", f"a{i + 1}") for i in range(30)] * 2 + [("a5", "b"), ("b", "a5"), ("z", "a1")]
    found = graph.reachable(spark.createDataFrame(chain, "src string, dst string"), spark.createDataFrame([("a3",)], "id string"))
    assert sorted(r.id for r in found.collect()) == sorted(["b", *(f"a{i}" for i in range(3, 31))])


def test_stream_is_called_once_for_a_user(spark, tmp_path, monkeypatch):
    stated = stream_queries._stated(spark.range(0).selectExpr("id AS event_id", "id AS user_id", "'a' AS event_type"))
    keys, group = [], type(stated).groupBy
    monkeypatch.setattr(type(stated), "groupBy", lambda self, *c: keys.append(c) or group(self, *c))
    ingest.reconciled(spark.readStream.schema(stated.schema).parquet(str(tmp_path)))
    assert keys == [("user_id",)]  # not for each subject and predicate


def test_length_of_a_vector_is_made_once(spark):
    plan = spark.createDataFrame([([3.0, 4.0],)], "v array<double>").select(vectors.unit("v").alias("v"))
    assert plan._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1  # not for each of its numbers
    assert plan.first().v == [0.6, 0.8]


def test_search_keeps_vectors_where_they_lie(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 6))
    x[:900] = x[0]  # equal vectors, of which the first ids count
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<double>")
    index = ann.VectorIndex(spark, str(tmp_path / "index"), cells=20)
    index.sync(rows)
    kept, stored = [], ann.stored
    monkeypatch.setattr(ann, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    monkeypatch.setattr(ann, "MISSED", -1.0)  # every cell is probed
    got = index.search(rows.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), 5, exact_rows=0).orderBy("query_id", "rank").collect()
    asked = np.arange(0, 3000, 20)
    assert [(r.query_id, r.id, r.score) for r in got] == _best(asked, x[asked], np.arange(3000), x, 5, -1.0)
    assert {(r.looked_at, r.path) for r in got} == {(3000, "exact_fallback")}
    assert all(df.count() <= 150 for df in kept if "vector" in df.columns)  # not a vector for each query and cell


def test_rules_are_tried_on_texts_with_their_words(spark, monkeypatch):
    tried = lambda kind: lambda *_, **__: F.raise_error(F.lit("tried")).cast(kind)
    monkeypatch.setattr(claims, "assertion", tried("string"))
    monkeypatch.setattr(rules, "spoken", tried("array<string>"))
    monkeypatch.setattr(rules, "uncertain", tried("boolean"))
    c, rules_of = F.col("text"), (rules.constraint, rules.completed, rules.negated_task, rules.durable_fact, rules.self_disclosure)
    texts = spark.createDataFrame([("the weather was fine in Rome",), ("Thanks!",)], "text string")
    for r in texts.select(claims.claims_of(c).alias("claims"), tasks.action(c).alias("action"), *[f(c).alias(f.__name__) for f in rules_of]).collect():
        assert r.claims.one is None and r.claims.all == [] and r.action is None and not any(r[f.__name__] for f in rules_of)
    monkeypatch.undo()
    said = spark.createDataFrame([("I LIVE in Rome. My name is Rex",), ("I don\u2019t like tea",), ("Actually, I work at Acme",)], "text string")
    assert [(r.c.one is not None, [x.predicate for x in r.c.all]) for r in said.select(claims.claims_of(c).alias("c")).collect()] == [(False, ["residence", "name"]), (True, ["taste"]), (True, ["employer"])]


def test_similar_texts_meet_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n = np.sort(rng.integers(1, 900, 300))
    sets = [rng.choice(2**62, k, replace=False) for k in n]
    sets += [s[rng.random(len(s)) > rng.random() * 0.3] for s in sets]
    sets = [np.asarray(s, np.int64) for s in sets if len(s)]
    size, maps = reconcile._bitmaps(pa.array([s.tolist() for s in sets], pa.list_(pa.int64())))
    words = [frozenset(s.tolist()) for s in sets]
    low = 0.75
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(words[i] & words[j]) >= low * len(words[i] | words[j])}
    classes = {}
    for c, k, b in zip(reconcile._size_class(size).tolist(), size.tolist(), (len(m.as_py()) for m in maps), strict=True):
        r, total, lo, hi = classes.get(c, (0, 0, k, k))
        classes[c] = (r + 1, total + b, min(lo, k), max(hi, k))
    of, where, tiles = reconcile._blocks([(c, *v) for c, v in classes.items()], low, 20)
    assert tiles > 20 and any(parts > 1 for _, parts in of.values())
    held = {}
    for i, c in enumerate(reconcile._size_class(size).tolist()):
        first, parts = of[c]
        for tile, side in where[first + i % parts]:
            held.setdefault(tile, []).append((i, side))
    assert max(map(len, held.values())) <= 60
    got = []
    for rows in held.values():
        rows, side = (np.array(x) for x in zip(*rows, strict=True))
        a, b = reconcile._near(size[rows], maps.take(pa.array(rows)), side, low)
        got += [tuple(sorted(x)) for x in zip(rows[a].tolist(), rows[b].tolist(), strict=True)]
    assert len(got) == len(set(got)) and want <= set(got) and len(got) < 1.2 * len(want)
    # texts of one wording but for few words: no pair is written before its bitmaps met, none goes through the driver
    texts = [" ".join([f"a{x}" for x in range(60)] + [f"b{i}w{x}" for x in range(60)]) for i in range(300)]
    texts += [t + " more" for t in texts[:20]] + texts[:5]
    plans, made = [], []

    def stored(df, store=reconcile.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = store(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(reconcile, "stored", stored)
    monkeypatch.setattr(reconcile, "BROADCAST_IDS", -1)
    found = reconcile.similar_pairs(spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "id long, text string"))
    assert not any("Broadcast" in p for p in [*plans, found._jdf.queryExecution().executedPlan().toString()])
    assert sorted(map(tuple, found.collect())) == [(i + 1, i + 301, round(120 / 121, 6)) for i in range(20)]
    assert max(made) <= len(texts)  # words that all texts have made 44,850 pairs of them


def test_groups_of_similar_texts_are_cut(spark, monkeypatch):
    texts = [" ".join([f"a{x}" for x in range(40)] + [f"b{i}"]) for i in range(60)]
    monkeypatch.setattr(reconcile, "TASK_PAIRS", 100)
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(reconcile, "_shared_words", lambda pairs, sets, kind, f=reconcile._shared_words: (seen.add(int(pairs.num_rows > 300)), f(pairs, sets, kind))[1])
    got = reconcile.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()
    assert sorted(map(tuple, got)) == [(i, j, round(40 / 42, 6)) for i in range(60) for j in range(i + 1, 60)]
    assert seen.value == 0
