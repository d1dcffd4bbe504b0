"""Retrieval: keyword ranking, channel fusion, chunking, and contexts of a limited size.

A batch of queries is a DataFrame, and every step is keyed by query_id, so one plan answers one
query or many.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import rules
from engramlake.operators import ids
from engramlake.session import stored

FUSION = {"keyword": 0.3, "semantic": 0.5, "graph": 0.2}
FUSION_OFFSET, AGREEMENT = 60, 0.002
#: Queries that a task holds at a time, words of rows that are looked up in them at a time, and bytes of texts that are held as strings.
QUERY_BLOCK, MET, TEXT_BYTES = 4096, 1 << 20, 1 << 20
#: Word overlap beyond which a text repeats a chosen one.
NEAR_REPEAT = 0.9
_WORD = re.compile(r"\w+")


class _Asked:
    """A block of queries, by word: which of them hold it."""

    def __init__(self, rows: list[tuple[int | str, list[str], str | None]], of: str):
        self.ids = ids.array([q for q, _, _ in rows], of)
        self.sizes = np.array([len(t) for _, t, _ in rows], np.int64)
        self.owners = pa.array(sorted({o for _, _, o in rows if o is not None}), pa.string())
        self.owner = pc.index_in(pa.array([o for _, _, o in rows], pa.string()), self.owners).fill_null(-1).to_numpy()
        words: dict[str, list[int]] = {}
        for k, (_, t, _) in enumerate(rows):
            for w in t:
                words.setdefault(w, []).append(k)
        self.words = pa.array(list(words), pa.string())
        self.first = np.cumsum([0, *map(len, words.values())])
        self.holds = np.concatenate([np.array(v, np.int64) for v in words.values()]) if words else np.zeros(0, np.int64)

    def pairs(self, tokens: pa.Array, owners: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, shared words) for lists of words, of a query and a row with one owner; some rows at a time, so that about MET words of queries are held."""
        row = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))
        at = pc.index_in(tokens.flatten(), self.words)
        met = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        w = at.take(pa.array(met)).to_numpy(zero_copy_only=False).astype(np.int64)
        every, row = self.first[w + 1] - self.first[w], row[met]
        own = pc.index_in(owners, self.owners).fill_null(-1).to_numpy()
        lo, total = 0, np.cumsum(every)
        while lo < len(w):
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + MET, "right"))
            hi = int(np.searchsorted(row, row[max(lo, min(hi, len(w) - 1))], "left" if lo < hi < len(w) else "right"))  # whole rows
            hi = hi if hi > lo else int(np.searchsorted(row, row[lo], "right"))
            n = every[lo:hi]
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[w[lo:hi]], n)
            q, r = self.holds[place], np.repeat(row[lo:hi], n)
            mine = own[r] == self.owner[q]
            cell, shared = np.unique(r[mine] * len(self.ids) + q[mine], return_counts=True)
            yield cell % len(self.ids), cell // len(self.ids), shared
            lo = hi


def _best(q: np.ndarray, of: np.ndarray, shared: np.ndarray, score: np.ndarray, made: np.ndarray, k: int) -> np.ndarray:
    """Places of the k rows of each query with the best score; the newer row, then the smaller id wins a tie."""
    order = np.lexsort((of, -made, -score, q))
    first = np.flatnonzero(np.concatenate([[True], np.diff(q[order]) != 0])) if len(q) else np.zeros(0, np.int64)
    return order[np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k]


def keyword_hits(queries: DataFrame, texts: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, shared, coverage, rank): texts (id, text) by the share of a query's words that they hold; the smaller id wins a tie."""
    plain = texts.select("id", "text", F.lit(0.0).alias("rest"), F.lit(0).cast("bigint").alias("made"))
    found = keyword_ranked(queries, plain, k, 1.0, block)
    return found.select("query_id", "id", "shared", F.round("score", 6).alias("coverage"), "rank")


def keyword_ranked(queries: DataFrame, texts: DataFrame, k: int, weight: float, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, shared, score, rank): texts (id, text, rest, made) that share a word with a query (query_id, text), by
    ``weight`` times the share of its words that they hold, and ``rest``; the newer one, then the smaller id wins a tie.

    Where both have an ``owner``, only texts of the query's owner count. Queries go to the texts, ``block`` of
    them at a time; a task keeps each query's ``k`` best of the texts that it has seen, so at most k rows
    for a query and task are shuffled and no word is a key.
    """
    both = "owner" in queries.columns and "owner" in texts.columns
    owner = (F.col("owner").cast("string") if both else F.lit("")).alias("owner")
    q_kind, kind = ids.kind(queries, "query_id"), ids.kind(texts)
    asked = queries.select(F.col("query_id").cast(q_kind).alias("query_id"), rules.tokens(F.col("text")).alias("t"), owner).filter("size(t) > 0")
    blocks = max(1, -(-asked.count() // block))
    if blocks > 1:
        asked = stored(asked)
    held = texts.select(F.col("id").cast(kind).alias("id"), rules.tokens(F.col("text")).alias("t"), F.col("rest").cast("double").alias("rest"), F.col("made").cast("long").alias("made"), owner)
    parts = []
    for i in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()  # about ``block`` queries
        sent = texts.sparkSession.sparkContext.broadcast(_Asked([tuple(r) for r in rows], q_kind))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            of = sent.value
            best = [np.zeros(0, np.int64), ids.empty(kind), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
            for b in batches:
                if not len(of.ids) or not b.num_rows:
                    continue
                for q, row, shared in of.pairs(b.column("t").fill_null([]), b.column("owner")):
                    column = lambda c, b=b, row=row: b.column(c).to_numpy(zero_copy_only=False)[row]
                    score = weight * (shared / of.sizes[q]) + column("rest")
                    full = np.bincount(best[0], minlength=len(of.ids)) >= k
                    least = np.full(len(of.ids), np.inf)  # what a query's last place holds, once all are taken
                    np.minimum.at(least, best[0], best[3])
                    keep = score >= np.where(full, least, -np.inf)[q]
                    new = (q[keep], ids.array(b.column("id").take(pa.array(row[keep])), kind), shared[keep], score[keep], column("made")[keep])
                    best = [np.concatenate([a, x]) for a, x in zip(best, new, strict=True)]
                    chosen = _best(*best, k)
                    best = [a[chosen] for a in best]
            cols = [of.ids[best[0]] if len(best[0]) else ids.empty(q_kind), *best[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "id", "shared", "score", "made"])

        parts.append(held.mapInArrow(run, f"query_id {q_kind}, id {kind}, shared bigint, score double, made bigint"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("made").desc(), "id")
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "id", "shared", "score", "rank")


def fused(channels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, id, score, n_channels, rank) from (query_id, channel, id, rank): reciprocal ranks, weighted, with a bonus for agreement."""
    weight = F.create_map(*[F.lit(x) for kv in (weights or FUSION).items() for x in kv])[F.col("channel")]
    part = F.coalesce(weight, F.lit(1.0)) / (FUSION_OFFSET + F.col("rank"))
    found = channels.groupBy("query_id", "id").agg(F.sum(part).alias("s"), F.count_distinct("channel").alias("n_channels"))
    found = found.select("query_id", "id", F.round(F.col("s") + AGREEMENT * (F.col("n_channels") - 1), 9).alias("score"), "n_channels")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")))


def head_and_tail(channels: DataFrame, depth: int, weights: dict[str, float] | None = None) -> DataFrame:
    """As ``fused``, but ids with a rank up to ``depth`` come first, scored by those ranks alone, so a wider pool never reorders them."""
    head = fused(channels.filter(F.col("rank") <= depth), weights).select("query_id", "id", F.col("score").alias("head_score"))
    every = fused(channels, weights).select("query_id", "id", "score", "n_channels")
    both = every.join(head, ["query_id", "id"], "left").withColumn("is_tail", F.col("head_score").isNull())
    w = Window.partitionBy("query_id").orderBy("is_tail", F.coalesce("head_score", "score").desc(), "id")
    return both.select("query_id", "id", "is_tail", F.coalesce("head_score", "score").alias("score"), F.row_number().over(w).alias("rank"))


def best_chunk(hits: DataFrame, owner: str) -> DataFrame:
    """The best chunk of each record and query; the earlier one wins a tie."""
    w = Window.partitionBy("query_id", owner).orderBy(F.col("score").desc(), "chunk_id")
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def chunk_bounds(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text) and (cut := text.rfind(" ", start + size // 2, end)) > start:
            end = cut
        out.append((start, end))
        if end == len(text):
            break
        start = max(start + 1, end - overlap)
    return out


def chunks(texts: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """(id, chunk_id, start, end, text): windows that end at a space of their second half. Each start follows from the end before, so a text is one loop."""
    if size < 100 or not 0 <= overlap < size:
        raise ValueError("chunks of 100 characters at least, with a smaller overlap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, "text"):
                rows = [(i, f"{i}:{a}", a, e, t[a:e]) for i, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True) if t for a, e in chunk_bounds(t, size, overlap)]
                cols = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["id", "chunk_id", "start", "end", "text"])

    kind = ids.kind(texts)
    types = (ids.arrow(kind), pa.string(), pa.int32(), pa.int32(), pa.string())
    return texts.select(F.col("id").cast(kind).alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"id {kind}, chunk_id string, start int, end int, text string")


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about TEXT_BYTES together, or single rows."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TEXT_BYTES, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def contexts(hits: DataFrame, budget: int) -> DataFrame:
    """(query_id, id, place, used) from (query_id, id, rank, text): a budget of characters filled in an order of
    coverage gain and novelty; a text that nearly repeats a chosen one, or does not fit, is passed over.

    The choice depends on the choices before it, so all hits that are given for a query are one group:
    give a ranked list, not a corpus.
    """

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.id, int(r.rank), r.text, words_of(r.text)) for r in f.sort_values("rank").itertuples()]
        chosen, covered, used, out = [], set(), 0, []
        while rows:
            best = min(rows, key=lambda r: (-len(r[3] - covered), max((alike(r[3], c) for c in chosen), default=0.0), r[1]))
            rows.remove(best)
            if any(alike(best[3], c) > NEAR_REPEAT for c in chosen) or used + len(best[2]) + 1 > budget:
                continue
            chosen.append(best[3])
            covered |= best[3]
            used += len(best[2]) + 1
            out.append((f["query_id"].iloc[0], best[0], len(out) + 1, used))
        return pd.DataFrame(out, columns=["query_id", "id", "place", "used"])

    return hits.groupBy("query_id").applyInPandas(choose, f"query_id {ids.kind(hits, 'query_id')}, id {ids.kind(hits)}, place int, used int")


def words_of(text: str) -> frozenset[str]:
    """The distinct words of a text, folded, inside a Python worker."""
    return frozenset(_WORD.findall(text.casefold()))


def alike(a: frozenset, b: frozenset) -> float:
    return len(a & b) / max(1, len(a | b))
