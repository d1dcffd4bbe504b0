"""Benchmark decontamination by suffix arrays over the training text.

The training words of each run of rows (a shard) become a suffix array: word positions sorted by
the twelve words that follow, more than the usual window of ten has. Every window of a benchmark item is the prefix
of a test suffix; binary searches, four words at a time, find the positions that start with it (with its
first twelve words, if a window is longer), and each of its words is compared to confirm them. Runs of confirmed windows of one item are its verbatim
matches, so the longest one is as long as the text and the item agree.

Shards live inside tasks, so the documents are read once and never shuffled. The benchmark is sent
to the tasks in blocks of at most ``BLOCK_WORDS`` words; more blocks make more passes, each of which
carries on what the one before found, so the size of the benchmark bounds nothing else.

Edge cases: very long texts are a shard of their own; null and empty texts have no words and are clean; items without words or without an id
match nothing; a document row is judged by itself, so repeated rows get equal results; an empty
benchmark leaves all clean.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm import text as T

WINDOW = 10
#: Words of the benchmark that a task holds at a time: about 60 MB.
BLOCK_WORDS = 500_000
_KEY_WORDS, _KEYS = 4, 3  # words of a suffix in a sort key, 16 bits each, and keys one after another

SCHEMA = "doc_id bigint, n_words bigint, hit_starts array<int>, hit_ends array<int>, items array<string>, longest int, longest_start int, longest_item string"


class Windows:
    """The distinct windows of some items, as test suffixes for the binary search."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = [i for i, _ in items]
        hashes, owners, places = {}, {}, {}
        for c in T.chunks(pa.array([t for _, t in items], pa.string()), 1 << 60):
            start, end, row = T.spans(c.buf, c.offs, T.ALNUM)
            h, at = T.Hasher(c.buf)(start, end), T.per_row(row, c.rows)
            for i in range(c.rows):
                a, b = int(at[i]), int(at[i + 1])
                n = min(window, b - a)
                if n:
                    rows = np.lib.stride_tricks.sliding_window_view(h[a:b], n)
                    hashes.setdefault(n, []).append(rows)
                    owners.setdefault(n, []).append(np.full(len(rows), i))
                    places.setdefault(n, []).append(np.arange(len(rows)))
        #: By length: the distinct windows, where the (item, place) of each are, and the bounds of their sort keys.
        self.by_length = {}
        for n, rows in hashes.items():
            rows, owner, place = np.concatenate(rows), np.concatenate(owners[n]), np.concatenate(places[n])
            whole = combined(rows)
            order = np.argsort(whole, kind="stable")
            whole, owner, place = whole[order], owner[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
            rows = rows[order[first]]
            bounds = [key_range(rows[:, k * _KEY_WORDS : (k + 1) * _KEY_WORDS]) for k in range(min(_KEYS, -(-n // _KEY_WORDS)))]
            self.by_length[n] = (rows, np.append(first, len(whole)), owner, place, bounds)


def combined(rows: np.ndarray) -> np.ndarray:
    """One hash for each row of word hashes, in their order."""
    out = np.full(len(rows), rows.shape[1], np.uint64)
    for k in range(rows.shape[1]):
        out = T.mix(out * np.uint64(0xD6E8FEB86659FD93) + rows[:, k])
    return out


def key_range(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest sort key of suffixes that start with these words."""
    lo, hi = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
    for k in range(_KEY_WORDS):
        part = np.uint64(16 * (_KEY_WORDS - 1 - k))
        if k < rows.shape[1]:
            w = (rows[:, k] >> np.uint64(48)) << part
            lo, hi = lo | w, hi | w
        else:
            hi = hi | (np.uint64(0xFFFF) << part)
    return lo, hi


def suffix_array(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions sorted by the words that follow, and their sort keys, a row for each four words."""
    padded = np.concatenate([h >> np.uint64(48), np.zeros(_KEY_WORDS - 1, np.uint64)])
    key = np.zeros(len(h), np.uint64)
    for k in range(_KEY_WORDS):
        key = (key << np.uint64(16)) | padded[k : k + len(h)]
    order = np.argsort(key, kind="stable")
    later = [np.concatenate([key[k * _KEY_WORDS :], np.zeros(min(k * _KEY_WORDS, len(h)), np.uint64)]) for k in range(1, _KEYS)]
    first = key[order]
    tied = np.zeros(len(h), bool)  # only where the first four words agree do the next ones matter
    tied[1:] = first[1:] == first[:-1]
    tied[:-1] |= tied[1:]
    at = np.flatnonzero(tied)
    if len(at):
        some = order[at]
        order[at] = some[np.lexsort((*[k[some] for k in reversed(later)], key[some]))]
    return order, np.stack([first, *[k[order] for k in later]])


def _bisect(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """For each search the place of ``wanted`` among the sorted ``keys`` from ``lo`` to ``hi``, before or after equal ones."""
    lo, hi = lo.copy(), hi.copy()
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live]) // 2
        up = keys[mid] <= wanted[live] if right else keys[mid] < wanted[live]
        lo[live], hi[live] = np.where(up, mid + 1, lo[live]), np.where(up, hi[live], mid)
    return lo


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range of each."""
    n = hi - lo
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), owner


def search(c: T.Chunk, w: Windows) -> tuple[np.ndarray, np.ndarray, list]:
    """Row bounds in words, the row of each word, and the matches: (length, word positions in order, windows)."""
    start, end, row = T.spans(c.buf, c.offs, T.ALNUM)
    at, found = T.per_row(row, c.rows), []
    if len(start):
        h = T.Hasher(c.buf)(start, end)
        order, keys = suffix_array(h)
        for n, (rows, _, _, _, bounds) in w.by_length.items():
            a, b = np.searchsorted(keys[0], bounds[0][0], "left"), np.searchsorted(keys[0], bounds[0][1], "right")
            which = np.flatnonzero(b > a)
            a, b = a[which], b[which]
            for level, (lo, hi) in enumerate(bounds[1:], 1):
                a, b = _bisect(keys[level], a, b, lo[which], False), _bisect(keys[level], a, b, hi[which], True)
                kept = b > a
                which, a, b = which[kept], a[kept], b[kept]
            for i in range(0, len(which), 1 << 14):
                pick, of = _ranges(a[i : i + (1 << 14)], b[i : i + (1 << 14)])
                p, k = order[pick], which[i : i + (1 << 14)][of]
                fits = p + n <= len(h)
                p, k = p[fits], k[fits]
                same = row[p] == row[p + n - 1]
                for j in range(n):  # word by word
                    same &= h[p + j] == rows[k, j]
                found.append((n, p[same], k[same]))
    return at, row, found


def _scan(c: T.Chunk, w: Windows, before: list | None) -> dict[str, list]:
    at, row, found = search(c, w)
    out = {k: [] for k in ("hit_starts", "hit_ends", "items", "longest", "longest_start", "longest_item")}
    edges = np.zeros(int(at[-1]) + 1, np.int64)
    owners, matches = [], []
    for n, p, k in found:
        np.add.at(edges, p, 1)
        np.add.at(edges, p + n, -1)
        _, bounds, owner, place, _ = w.by_length[n]
        pick, which = _ranges(bounds[k], bounds[k + 1])
        item, q = owner[pick], p[which]
        owners.append(np.unique(np.stack([row[q], item]), axis=1))
        if len(q):  # windows of one item at successive places join to one match
            o = np.lexsort((q, q - place[pick], item))
            q, item, shift = q[o], item[o], (q - place[pick])[o]
            new = np.concatenate([[True], (q[1:] != q[:-1] + 1) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (row[q[1:]] != row[q[:-1]])])
            first = np.flatnonzero(new)
            matches += zip(row[q[first]].tolist(), (np.diff(np.append(first, len(q))) + n - 1).tolist(), q[first].tolist(), item[first].tolist(), strict=True)
    best: dict[int, tuple] = {}
    for r, n, p, i in matches:
        x = (-n, p - int(at[r]), w.names[i])
        best[r] = min(best.get(r, x), x)
    items: dict[int, set] = {}
    for r, i in (np.concatenate(owners, axis=1).T.tolist() if owners else []):
        items.setdefault(r, set()).add(w.names[i])
    hit = np.cumsum(edges[:-1]) > 0
    for r in range(c.rows):
        mine, old = hit[at[r] : at[r + 1]], before[r] if before else None
        if old and old["items"]:
            mine = mine.copy()
            for a, b in zip(old["hit_starts"], old["hit_ends"], strict=True):
                mine[a:b] = True
            items[r] = items.get(r, set()) | set(old["items"])
            x = (-old["longest"], old["longest_start"], old["longest_item"])
            best[r] = min(best.get(r, x), x)
        if r in items:
            step = np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))
            out["hit_starts"].append(np.flatnonzero(step == 1).tolist())
            out["hit_ends"].append(np.flatnonzero(step == -1).tolist())
            out["items"].append(sorted(items[r]))
            n, p, i = best[r]
            out["longest"].append(-n)
            out["longest_start"].append(p)
            out["longest_item"].append(i)
        else:
            for k, v in (("hit_starts", []), ("hit_ends", []), ("items", []), ("longest", 0), ("longest_start", None), ("longest_item", None)):
                out[k].append(v)
    out["n_words"] = np.diff(at).tolist()
    return out


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[Broadcast]:
    """The items in blocks of about ``block_words`` words, sent to the tasks one block at a time."""
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = max(1, int(np.ceil(total / block_words)))
    for k in range(blocks):  # one, unless the benchmark is large
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()])


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: its words, the hit word ranges, the items met and the longest match.

    The result has the columns of ``docs`` that are read (doc_id, text) and those of ``SCHEMA``.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keep = "text string, " + SCHEMA
    for sent in _blocks(benchmark, block_words):
        held: dict[int, Windows] = {}

        def run(batch: pa.RecordBatch, sent=sent, held=held) -> pa.RecordBatch:
            if 0 not in held:
                held[0] = Windows(sent.value, window)
            rows = {x: [] for x in ("n_words", "hit_starts", "hit_ends", "items", "longest", "longest_start", "longest_item")}
            for c in T.chunks(batch.column("text")):
                old = batch.slice(c.lo, c.rows).to_pylist() if "items" in batch.schema.names else None
                for x, v in _scan(c, held[0], old).items():
                    rows[x] += v
            kinds = {"n_words": pa.int64(), "hit_starts": pa.list_(pa.int32()), "hit_ends": pa.list_(pa.int32()), "items": pa.list_(pa.string()), "longest": pa.int32(), "longest_start": pa.int32(), "longest_item": pa.string()}
            cols = {"text": batch.column("text"), "doc_id": batch.column("doc_id")} | {x: pa.array(rows[x], kinds[x]) for x in kinds}
            return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

        out = T.by_batch(out, run, keep)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that hold no window of a benchmark item, with all their columns, whatever these are called.

    A row whose doc_id is null, or repeated, is kept or removed by its own text. Each block of the benchmark
    removes its documents in one pass, without a join.
    """
    at = docs.columns.index("text")
    for sent in _blocks(benchmark, block_words):

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            windows = None
            for batch in batches:
                windows = windows or Windows(sent.value, window)
                clean = [np.zeros(0, bool)]
                for c in T.chunks(batch.column(at)):
                    _, row, found = search(c, windows)
                    ok = np.ones(c.rows, bool)
                    for _, p, _ in found:
                        ok[row[p]] = False
                    clean.append(ok)
                yield batch.filter(pa.array(np.concatenate(clean)))

        docs = T.small_batches(docs).mapInArrow(run, docs.schema)
    return docs


def digest(overlaps: DataFrame) -> DataFrame:
    """The contract's columns: one row per document."""
    hit = F.aggregate(F.zip_with("hit_starts", "hit_ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return overlaps.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"), "longest", "longest_start", "longest_item",
    )
