"""The filter audit, window removal and periodic runs beside plain re-computations, on whole tables and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from engramlake.llm import audit, queries, runs, superkmers
from engramlake.llm.text import mix

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SPACE = r"[^\x20\x09-\x0D]+"


def table(name: str) -> list[dict]:
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def audited(docs: list[tuple], labels: list[tuple]) -> set[tuple]:
    """docs: doc_id, text, source; labels: doc_id, quality, toxic."""
    quality, toxic = defaultdict(int), defaultdict(int)
    for i, q, t in labels:
        quality[i], toxic[i] = max(quality[i], q or 0), max(toxic[i], t or 0)
    least: dict[str, int] = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    rows = defaultdict(list)
    for i, t, s in docs:
        t = t or ""
        w = re.findall(SPACE, t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        rows[s or ""].append(("".join(k for k, v in fails.items() if v), quality.get(i) == 1, toxic.get(i) == 1))
    out = set()
    for part, of in rows.items():
        cells, total, found = Counter(of), Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                kept = removed = redundant = unique = good = bad = 0
                for (fails, q, t), n in cells.items():
                    earlier = set(order[: step - 1]) & set(fails)
                    kept += n * (not earlier and f not in fails)
                    removed += n * (not earlier and f in fails)
                    redundant += n * (bool(earlier) and f in fails)
                    unique += n * (fails == f)
                    good += n * (not earlier and f in fails and q)
                    bad += n * (not earlier and f in fails and t)
                total[f] += removed
                found.append((part, order, step, kept, removed, redundant, unique, good, bad))
        out |= {(*x, total[x[1][x[2] - 1]]) for x in found}
    return out


def test_audit_of_the_whole_table(spark):
    got = queries.op11_filter_audit(spark, SF)
    want = audited([(d["doc_id"], d["text"], d["source"]) for d in table("documents")], [(x["doc_id"], x["quality"], x["toxic"]) for x in table("labels")])
    rows = got.collect()
    assert len(rows) == len(want)
    assert {tuple(r) for r in rows} == want
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    docs = [
        (1, None, None), (2, "", ""), (3, "", "a"), (4, long, "a"), (5, long, "a"), (5, long, "a"), (4, long, "b"), (None, long, "a"),
        (6, "A B C D", "b"), (7, "x # y", "b"), (7, "x é z", None), (8, "one one " * 40, "a"),
    ]
    labels = [(1, 1, 1), (2, None, 1), (4, 0, 1), (4, 1, None), (9, 1, 1), (None, 1, 1)]
    made = spark.createDataFrame([(*d, "m", 3) for d in docs], "doc_id bigint, text string, source string, mask string, least int")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = [tuple(r) for r in audit.audit(made, marks).collect()]
    assert len(got) == 600 * 3
    assert set(got) == audited(docs, [x for x in labels if x[0] is not None])
    assert audit.audit(made.limit(0), marks).count() == 0
    assert audit.audit(made, marks.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def without_shared(docs: list[tuple[int | None, str | None]], window: int = 13) -> list[tuple]:
    least: dict[tuple, int] = {}
    words = [re.findall(SPACE, t or "") for _, t in docs]
    for (i, _), w in zip(docs, words, strict=True):
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = {k + j for k in range(len(w) - window + 1 if i is not None else 0) if least[tuple(w[k : k + window])] < i for j in range(window)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def key(r: tuple) -> str:
    return repr(r)


def test_windows_of_the_whole_table(spark):
    got = [tuple(r) for r in queries.op12_substring_dedup(spark, SF).collect()]
    assert sorted(got, key=key) == sorted(without_shared([(d["doc_id"], d["text"]) for d in table("documents")]), key=key)


@pytest.mark.parametrize("most", [superkmers.BUCKET_BYTES, 1])
def test_windows_of_odd_rows(spark, monkeypatch, most):
    """Also where every cell is too large for a bucket."""
    if most == 1:
        monkeypatch.setattr(superkmers, "deal", lambda cells, _: np.where(cells > 0, -1, 0).astype(np.int32))
    rng = random.Random(3)
    line = " ".join(f"l{k}" for k in range(17))
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(60)) for _ in range(4)]
    docs = [(1, None), (2, ""), (3, " \t"), (4, "a " * 12), (5, "a " * 13), (6, "a\n" * 30), (7, "a " * 700), (8, "é x " * 20), (9, "é x\t" * 20), (None, base[0])]
    docs += [(10 + k, f"{base[k % 4]}\n{line} {k} {base[(k + 1) % 4][: 10 * k]}") for k in range(24)]
    docs += [(10, base[1] + " " + line), (10, base[1] + " " + line), (60, base[0].upper()), (61, base[0].replace(" ", "  "))]
    made = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id bigint, text string, copy int, words string, taken int").repartition(3)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in superkmers.remove(made).collect()]
    assert sorted(got, key=key) == sorted(without_shared(docs), key=key)
    assert superkmers.remove(made.limit(0)).count() == 0


def test_windows_of_one_hash_are_told_apart():
    texts = [" ".join(f"{a}{k}" for k in range(20)) for a in "abcab"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    doc = np.array([5, 6, 7, 8, 6])
    blind = lambda h, k: np.zeros(len(h), np.uint64)
    for hashes in (superkmers.run_hashes, blind):
        k, a, b = superkmers.shared_windows(buf, offs, doc, hashes=hashes)
        assert (k.tolist(), a.tolist(), b.tolist()) == ([3], [0], [7])


def test_super_k_mers_are_few_and_whole():
    from engramlake.llm.text import Chunk

    rng = random.Random(9)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(5000)).encode()
    found = superkmers.super_kmers(Chunk(0, 1, np.frombuffer(text, np.uint8), np.array([0, len(text)])))
    words = text.split()
    got = [found.buf[a:b].tobytes().split() for a, b in zip(found.begin, found.end, strict=True)]
    assert all(w == words[f : f + len(w)] for f, w in zip(found.first.tolist(), got, strict=True))
    assert sum(len(w) - 12 for w in got) == 5000 - 12  # each window once
    assert sum(map(len, got)) < 4 * 5000


def periodic(i: int | None, w: list[str]) -> list[str]:
    h = zlib.crc32(str(i).encode())
    if i is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def described(i: int | None, t: str | None) -> tuple:
    w = periodic(i, re.findall(SPACE, t or ""))
    found = runs.brute_force(w)
    best = (None,) * 4
    for s, n, q in found:
        if best[0] is None or (n * best[2] > best[1] * q) or (n * best[2] == best[1] * q and (s, q) < (best[0], best[2])):
            best = (s, n, q, 1000 * n // q)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return (i, len(found), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_of_the_whole_table(spark):
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()]
    want = [described(d["doc_id"], d["text"]) for d in table("documents")]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(w[1] for w in want) >= 20


def test_runs_of_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "a a a a a"), (4, "a a a a a a"), (5, "b " + "x y " * 4 + "x"), (6, "x y " * 3), (7, "é é\n" * 50 + "z"), (None, "q " * 9)]
    docs += [(k, "a b c " * k) for k in range(8, 40)] + [(8, "u v " * 30)] * 2 + [(50, "a\x00b " * 8), (51, ("k " * 6 + "m ") * 5)]
    docs += [(100, " ".join(f"w{k % 9001}" for k in range(40_000)))]  # more than a chunk with its neighbours
    made = spark.createDataFrame([(*d, 1, "r") for d in docs], "doc_id bigint, text string, start int, runs string")
    got = [tuple(r) for r in runs.detect(made, planted=True).drop("runs", "n_words", "n_dropped").collect()]
    assert sorted(got, key=key) == sorted([described(*d) for d in docs], key=key)
    assert runs.detect(made.limit(0)).count() == 0


def test_runs_of_any_words():
    rng = random.Random(5)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 40), rng.choice([1, 2, 3, 4])
            w = [rng.randint(0, k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(2, 9)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        least, repeats = rng.choice([(6, 4), (2, 2), (4, 2), (6, 3)])
        at = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
        row, start, length, period = runs.find_runs(np.array(sum(texts, []), np.int64), at, least, repeats)
        for r, w in enumerate(texts):
            own = row == r
            got = sorted(zip(start[own].tolist(), length[own].tolist(), period[own].tolist(), strict=True), key=lambda x: (x[0], x[2]))
            assert got == runs.brute_force(w, least, repeats)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_substring_dedup"])
def test_sql_says_the_same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    rel = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    got = queries.queries()[name](spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())


def test_hashes_of_runs_differ_by_length():
    h = mix(np.arange(1, 40, dtype=np.uint64))
    assert len({int(superkmers.run_hashes(h, k)[0]) for k in range(1, 20)}) == 19
