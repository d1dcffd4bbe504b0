"""Near-duplicate groups by MinHash bands, odd sketches and confirmed Jaccard similarity.

1. A pass over the texts makes, for each document, the keys of 32 bands of 4 MinHash samples of its
   shingle set, and an odd sketch: the minima of 2^15 bins of one permutation (MinHash samples too)
   folded into a parity bitmap, so that the population count of two bitmaps' XOR tells how many
   samples differ. For sets of up to some thousand shingles that is nearly exact; for sets far beyond
   20,000 the bitmap fills up and rules nothing out, which leaves more pairs to the full sets.
2. Documents of equal sets form a class, which one of them stands for from then on.
3. Each band bucket offers its members one hub, the smallest id; the sketches pick the best hub of
   each member; full sets confirm the link. These links' components become labels.
4. Only members of one bucket with different labels and sizes near enough for a link are then
   compared with each other: sketches inside the join, full sets after it. Links inside a component
   change nothing, so none is lost.

A pair of similarity 0.8 misses all bands with probability (1 - 0.8^4)^32 < 1e-7. The sketches drop
a pair only if its equal samples are five standard deviations fewer than a similarity at the
threshold makes. A pair is put out in the first bucket that it shares, once. No group is collected,
and there is no cap on buckets or partners.

Edge cases: null text and text without words have an empty set, are linked with nothing and are
kept; fewer words than a shingle make one shingle; rows that share a doc_id count as one document;
rows without a doc_id take the component of equal sets, if there is one.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.llm import text as T

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Bins of the one-permutation samples, and bits of the parity bitmap that they are folded into.
BINS, BITS = 1 << 15, 4096
SHINGLE, THRESHOLD = 5, 80
#: Standard deviations by which a sketch must miss the threshold.
SURE = 5.0

_rng = np.random.default_rng(71)
_MUL = _rng.integers(0, 2**31, SAMPLES, np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _rng.integers(0, 2**32, SAMPLES, np.uint32)
_ODD = [f"o{i}" for i in range(BITS // 64)]


def shingle_sets(c: T.Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, as hashes in the order of rows, and the row bounds."""
    start, end, row = T.spans(c.buf, c.offs, T.SPACED)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(c.rows + 1, np.int64)
    h, at = T.Hasher(c.buf)(start, end), T.per_row(row, c.rows)
    n = np.diff(at)
    out = np.full(len(h), k, np.uint64)
    for j in range(k):
        ahead = np.concatenate([h[j:], np.zeros(min(j, len(h)), np.uint64)])[: len(h)]
        out = T.mix(out * np.uint64(0xA24BAED4963EE407) + ahead)
    whole = np.arange(len(h)) + k <= at[1:][row]
    for i in np.flatnonzero((n > 0) & (n < k)):  # too short for one shingle
        x = np.full(1, 1000 + n[i], np.uint64)
        for w in h[at[i] : at[i + 1]]:
            x = T.mix(x * np.uint64(0xA24BAED4963EE407) + w)
        out[at[i]], whole[at[i]] = x[0], True
    s, r = out[whole], row[whole]
    order = np.argsort(s)
    if c.rows < 1 << 16:
        order = order[np.argsort(r[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(r[order], kind="stable")]
    s, r = s[order], r[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    return s[new], T.per_row(r[new], c.rows)


def _sketch(c: T.Chunk, k: int) -> dict[str, np.ndarray]:
    s, at = shingle_sets(c, k)
    n = np.diff(at)
    rows = np.flatnonzero(n)
    out = {"n": n, "m": np.zeros(c.rows, np.int64), "h1": np.zeros(c.rows, np.int64), "h2": np.zeros(c.rows, np.int64), "bands": np.zeros((c.rows, BANDS), np.int64)} | {o: np.zeros(c.rows, np.int64) for o in _ODD}
    if not len(rows):
        return out
    first = at[rows]
    x = (s >> np.uint64(32)).astype(np.uint32)
    m = np.empty((SAMPLES, len(rows)), np.uint32)
    for i in range(SAMPLES):
        m[i] = np.minimum.reduceat((x ^ _XOR[i]) * _MUL[i], first)
    out["h1"][rows] = np.add.reduceat(s, first).view(np.int64)
    out["h2"][rows] = np.add.reduceat(T.mix(s ^ np.uint64(0x5851F42D4C957F2D)), first).view(np.int64)
    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(rows), 1)
    for j in range(ROWS):
        key = T.mix(key * np.uint64(0xA24BAED4963EE407) + m[j::ROWS].astype(np.uint64))
    out["bands"][rows] = key.view(np.int64).T
    row = np.repeat(np.arange(len(rows)), n[rows])
    cell = (s >> np.uint64(49)).astype(np.int64) + row * BINS
    least = s[np.concatenate([[True], cell[1:] != cell[:-1]])]  # the first of each bin, as rows are sorted
    of = row[np.concatenate([[True], cell[1:] != cell[:-1]])]
    bit = (T.mix(least ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(BITS - 1)).astype(np.int64)
    out["m"][rows] = np.bincount(of, minlength=len(rows))
    odd = np.empty((len(rows), len(_ODD)), np.int64)
    cut = np.searchsorted(of, np.arange(0, len(rows) + 256, 256))
    for i in range(0, len(rows), 256):
        k = min(256, len(rows) - i)
        part = slice(cut[i // 256], cut[i // 256 + 1])
        parity = np.bincount(bit[part] + (of[part] - i) * BITS, minlength=k * BITS) & 1
        odd[i : i + k] = np.packbits(parity.astype(np.uint8).reshape(k, BITS), axis=1).view(np.int64)
    for o, v in zip(_ODD, odd.T, strict=True):
        out[o][rows] = v
    return out


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n (set size), m (samples in the sketch), h1 and h2 (of the set), bands, o0 to o63 (the odd sketch)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [_sketch(c, shingle) for c in T.chunks(batch.column("text"))]
        cols = {"doc_id": batch.column("doc_id")}
        for k in ("n", "m", "h1", "h2", *_ODD):
            cols[k] = pa.array(np.concatenate([p[k] for p in parts]))
        bands = np.concatenate([p["bands"] for p in parts])
        cols["bands"] = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), bands.ravel())
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, n bigint, m bigint, h1 bigint, h2 bigint, " + ", ".join(f"{o} bigint" for o in _ODD) + ", bands array<bigint>"
    return T.by_batch(read, run, schema)


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n, shingles: whole sets, for confirmation."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, n = [], []
        for c in T.chunks(batch.column("text")):
            s, at = shingle_sets(c, shingle)
            sets.append(s.view(np.int64))
            n.append(np.diff(at))
        n, s = np.concatenate(n), np.concatenate(sets)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), s)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), lists], ["doc_id", "n", "shingles"])

    return T.by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id bigint, n bigint, shingles array<bigint>")


def _odd_distance(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{o}").bitwiseXOR(F.col(f"{b}.{o}"))) for o in _ODD])


def _may_link(a: str, b: str, threshold: int) -> Column:
    """False only where set sizes rule a link out, or the sketches do by SURE standard deviations."""
    t = threshold / 100
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    fits = (x * 100 >= y * threshold) & (y * 100 >= x * threshold)
    # at the threshold: size of the union, bins that it fills, equal samples, different samples, odd bits
    union = (x + y) / (1 + t)
    filled = BINS * (1 - F.exp(-union / BINS))
    equal = t * filled
    differ = F.greatest(F.col(f"{a}.m") + F.col(f"{b}.m") - 2 * equal, F.lit(0.0))
    left = F.exp(-2 * differ / BITS)
    odd = BITS / 2 * (1 - left)
    # bits that cancel out, and how far the bins' filling and sharing varies
    variance = BITS / 4 * (1 - left * left) - differ * left * left + 4 * left * left * equal * F.greatest(1 - filled / union, F.lit(0.0))
    return fits & (_odd_distance(a, b) <= odd + SURE * F.sqrt(F.greatest(variance, F.lit(0.0))) + 2)


def confirmed(docs: DataFrame, pairs: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """Of the pairs (a, b) of doc_ids, those whose full sets are similar enough, stored. ``pairs`` should be stored."""
    ids = T.stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    wanted = T.with_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids, "left_semi")
    # rows that share a doc_id: the one with the smallest set stands for it
    sets = T.stored(full_sets(wanted, shingle).groupBy("doc_id").agg(F.min(F.struct("n", "shingles")).alias("s")).select("doc_id", "s.n", "s.shingles"))
    with_a = pairs.join(T.shuffled(sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))), "a")
    both = with_a.join(T.shuffled(sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    kept = both.select("a", "b", common.alias("common"), (F.col("na") + F.col("nb") - common).alias("union")).filter(F.col("common") * 100 >= F.col("union") * threshold)
    return T.stored(kept.select("a", "b"))


def roots(parents: DataFrame) -> DataFrame:
    """(id, label) of a forest (id, to): where the pointers end, which double in length each round."""
    at = T.stored(parents.withColumn("moved", F.lit(True)))
    while not at.filter("moved").isEmpty():
        x, y = at.alias("x"), T.shuffled(at).alias("y")
        at = T.stored(x.join(y, F.col("x.to") == F.col("y.id"), "left").select("x.id", F.coalesce("y.to", "x.to").alias("to"), F.col("y.to").isNotNull().alias("moved")))
    return at.select("id", F.col("to").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable from each id in ``edges`` (a, b).

    Each round points every id at its smallest neighbour, follows the pointers to their ends and
    contracts the edges, so at least half of the ids that still have edges go.
    """
    edges = T.stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = roots(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to")).filter("to < id"))
        grown = labels.join(T.shuffled(step.select(F.col("id").alias("label"), F.col("label").alias("to"))), "label", "left").select("id", F.coalesce("to", "label").alias("label")) if labels else step
        if labels:
            grown = grown.union(step.join(T.shuffled(labels), "id", "left_anti"))
        labels = T.stored(grown)
        of = lambda c: T.shuffled(step.select(F.col("id").alias(c), F.col("label").alias(f"{c}2")))
        moved = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))
        edges = T.stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    return labels if labels is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``threshold`` is the least similarity in hundredths, from 80 on; ``shingle`` the words of one.
    """
    if threshold < 80:
        raise ValueError("the bands are made for a similarity of 0.8 and more")
    base = sketches(docs, shingle)
    base = T.stored(base.withColumn("h1", F.when(F.col("n") > 0, F.col("h1")).otherwise(F.xxhash64("doc_id"))))
    # sketches depend on the set alone, so any row of a class has them
    same = [F.first(c).alias(c) for c in ("m", *_ODD, "bands")]
    reps = T.stored(base.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), *same))
    full = reps.filter("n > 0 and rep is not null")

    keys = full.select(F.posexplode("bands").alias("band", "key"), "rep")
    hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("members")).filter("members > 1").select("key", "hub")
    buckets = T.stored(keys.join(T.shuffled(hubs), "key"))
    asked = buckets.filter("rep <> hub").select("rep", "hub").distinct()
    sketch = full.select("rep", "n", "m", *_ODD)
    offered = (
        asked.join(T.shuffled(sketch).alias("x"), "rep").drop(F.col("x.rep")).alias("x")
        .join(T.shuffled(sketch).withColumnRenamed("rep", "other").alias("y"), F.col("x.hub") == F.col("y.other"))
        .filter(_may_link("x", "y", threshold))
        .select("x.rep", "x.hub", _odd_distance("x", "y").alias("d"))
    )
    first = T.stored(offered.groupBy("rep").agg(F.min(F.struct("d", "hub")).alias("best")).select(F.col("best.hub").alias("a"), F.col("rep").alias("b")))
    # a hub is smaller than its member and each member has one, so the confirmed links are a forest
    labels = roots(confirmed(docs, first, shingle, threshold).select(F.col("b").alias("id"), F.col("a").alias("to")))

    member = T.stored(buckets.select("key", "band", "rep").join(T.shuffled(labels).withColumnRenamed("id", "rep"), "rep", "left").select("key", "band", "rep", F.coalesce("label", "rep").alias("label")))
    mixed = member.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    rest = T.stored(member.join(T.shuffled(mixed), "key").join(T.shuffled(full.select("rep", "n", "m", *_ODD, "bands")), "rep"))
    # the larger set of a link is of the smaller one's size class or of the next, so a bucket of many lengths falls into parts
    size = F.floor(F.log("n") / (math.log(100 / threshold) + 0.01))
    x = rest.withColumn("size", F.explode(F.array(size, size + 1))).alias("x")
    y = T.shuffled(rest).withColumn("size", size).alias("y")
    ordered = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.label") < F.col("y.label")))
    before = F.arrays_overlap(F.slice("x.bands", F.lit(1), F.col("x.band")), F.slice("y.bands", F.lit(1), F.col("x.band")))
    same_part = (F.col("x.key") == F.col("y.key")) & (F.col("x.size") == F.col("y.size"))
    cross = (
        x.join(y, same_part & ordered & (F.col("x.label") != F.col("y.label")) & _may_link("x", "y", threshold) & ~before)
        .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb"))
        .distinct()
        .join(T.shuffled(first), ["a", "b"], "left_anti")
    )
    cross = T.stored(cross)
    if not cross.isEmpty():
        more = confirmed(docs, cross.select("a", "b").distinct(), shingle, threshold)
        joined = components(cross.join(T.shuffled(more), ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b")))
        moved = joined.select(F.col("id").alias("label"), F.col("label").alias("to"))
        labels = T.stored(labels.join(T.shuffled(moved), "label", "left").select("id", F.coalesce("to", "label").alias("label")).union(joined.join(T.shuffled(labels), "id", "left_anti")))

    named = reps.join(T.shuffled(labels).withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", F.coalesce("label", "rep").alias("component_id"))
    out = base.select("doc_id", "n", "h1", "h2").join(T.shuffled(named), ["h1", "h2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The documents with one of each near-duplicate group left, and one row of each doc_id."""
    found = T.stored(near_duplicates(docs, shingle, threshold))
    kept = T.with_ids(docs, T.stored(found.filter("not kept").select("doc_id")), "left_anti").select(*docs.columns)
    again = T.stored(found.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"))
    if again.isEmpty():
        return kept
    twice = T.with_ids(kept, again, "left_semi").select(*docs.columns)
    return T.with_ids(kept, again, "left_anti").select(*docs.columns).unionByName(twice.dropDuplicates(["doc_id"]))


def brute_force(rows: list[tuple[int, str | None]], shingle: int, threshold: int) -> dict[int, tuple[int, int]]:
    """doc_id to (n_shingles, component_id) by comparing all pairs, for tests."""
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + shingle]) for j in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                lo, hi = sorted((root(i), root(j)))
                label[hi] = lo
    return {i: (len(sets[i]), root(i)) for i in ids}
