"""Periodic runs of words: all stretches in which a few words repeat, by the runs theorem.

A run is a stretch of words with smallest period q, at least twice as long as q, that no neighbouring
word extends. By the runs theorem every run holds a longest Lyndon word of length q, under the order
of words or under the reverse order, so all runs come from two Lyndon words for each position:

1. Words become numbers, and each text of a chunk ends with a sentinel of its own that is smaller than
   all words. Prefix doubling sorts the suffixes; only suffixes that are not yet told apart are
   sorted again.
2. The longest Lyndon word at a position ends before the next smaller value of the inverse suffix
   array; under the reverse order (sentinels too), before the next greater one.
3. Equal prefixes of neighbouring suffixes (LCP), with a sparse table for range minima, tell how far
   the word and its next copy agree to the right. Those that agree far enough for the repeats asked
   for are extended to the left in the same way over the reversed texts.

Each text is one row's work, in chunks of about 1 MB; there is no shuffle. Memory is some 200 bytes a
word, so a text far beyond 10 million words needs a worker with more memory; it is never cut.

Edge cases: null text has no words and no runs; fewer words than the shortest run have none; repeated
rows get the same result; rows without a doc_id are read as they are; empty tables give no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm import text as T

LEAST_LENGTH, LEAST_REPEATS = 6, 4
SCHEMA = (
    "doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, "
    "collapsed_sha256 string, n_dropped bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>"
)


def word_ids(buf: np.ndarray, start: np.ndarray, end: np.ndarray, member: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal bytes and no others. The words are the maximal runs of member bytes."""
    data = buf[member[buf]]
    offs = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data.tobytes())])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def with_sentinels(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts (ids between the bounds ``at``), each followed by a smaller number of its own; and where each text starts."""
    rows = len(at) - 1
    first = at + np.arange(rows + 1)
    out = np.empty(len(ids) + rows, np.int64)
    ends = first[1:] - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = ids + rows
    out[ends] = np.arange(rows)
    return out, first


class Suffixes:
    """Suffix array, inverse suffix array and LCP of numbers of which the last occurs once, as with_sentinels makes them."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        order = np.argsort(s, kind="stable")
        slots = np.arange(n)
        key = s[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
        self.levels = [rank.astype(np.int32)]  # level k: equal numbers where 2**k numbers are equal
        self.order = order.copy()
        live, h = order, 1
        live, slots = self._open(live, slots, new)
        while len(live):
            ahead = np.minimum(live + h, n - 1)
            key = rank[live] * (n + 1) + np.where(live + h < n, rank[ahead] + 1, 0)
            by = np.argsort(key, kind="stable")
            live, key = live[by], key[by]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            self.order[slots] = live
            rank[live] = np.maximum.accumulate(np.where(new, slots, 0))
            self.levels.append(rank.astype(np.int32))
            live, slots = self._open(live, slots, new)
            h *= 2
        self.rank = rank
        a, b = self.order[:-1], self.order[1:]
        common = np.zeros(n, np.int32)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            common[1:] += (level[a + common[1:]] == level[b + common[1:]]).astype(np.int32) << k
        self.lcp = Sparse(common, np.minimum)

    @staticmethod
    def _open(live: np.ndarray, slots: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those whose group has others in it."""
        alone = new & np.concatenate([new[1:], [True]])
        return live[~alone], slots[~alone]

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Numbers that are equal from ``i`` and ``j`` on; the two differ."""
        a, b = self.rank[i], self.rank[j]
        return self.lcp.over(np.minimum(a, b) + 1, np.maximum(a, b) + 1)


class Sparse:
    """Minima or maxima of any ranges, from those of 2**k numbers at each place."""

    def __init__(self, values: np.ndarray, pick: Callable):
        self.rows, self.pick = [values], pick
        width = 1
        while 2 * width <= len(values):
            last = self.rows[-1]
            row = last.copy()
            row[: len(last) - width] = pick(last[: len(last) - width], last[width:])
            self.rows.append(row)
            width *= 2

    def over(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of lo to hi, hi not included; lo < hi."""
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.rows[0].dtype)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            row = self.rows[level]
            out[at] = self.pick(row[lo[at]], row[hi[at] - (1 << int(level))])
        return out

    def next_beyond(self, i: np.ndarray, beyond: Callable) -> np.ndarray:
        """The next place after each ``i`` whose value is beyond (np.less or np.greater) the value there; the length if there is none."""
        values, n = self.rows[0], len(self.rows[0])
        at, own = i + 1, values[i]
        for k in range(len(self.rows) - 1, -1, -1):
            width = 1 << k
            fits = at + width <= n
            skip = fits & ~beyond(self.rows[k][np.where(fits, at, 0)], own)
            at = at + np.where(skip, width, 0)
        return at


def find_runs(ids: np.ndarray, at: np.ndarray, least: int = LEAST_LENGTH, repeats: int = LEAST_REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start in the row, length and period of all runs of at least ``least`` words and ``repeats`` periods (2 or more), by row, start, period."""
    if repeats < 2:
        raise ValueError("a run has at least two periods")
    none = np.zeros(0, np.int64)
    if not len(ids):
        return none, none, none, none
    s, first = with_sentinels(ids, at)
    found = Suffixes(s)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    # the leftmost Lyndon root of a run agrees with its next copy over (repeats - 2) periods and a word more, or least - 2 * period + 1
    level = 2 if repeats >= 4 and least >= 6 and len(found.levels) > 2 else 0
    i = _again(found.levels[level], row, found.order)
    i = i[s[i] >= len(at) - 1]
    if not len(i):
        return none, none, none, none
    low, high = Sparse(found.rank, np.minimum), Sparse(found.rank, np.maximum)
    ends = np.concatenate([low.next_beyond(i, np.less), high.next_beyond(i, np.greater)])
    i = np.concatenate([i, i])
    p = ends - i
    inside = (i + p < first[row[i] + 1] - 1) & (repeats * p <= np.diff(at)[row[i]])
    i, p = i[inside], p[inside]
    right = found.agree(i, i + p).astype(np.int64) if len(i) else none
    enough = right >= np.maximum((repeats - 2) * p + 1, least - 2 * p + 1)
    i, p, right = i[enough], p[enough], right[enough]
    if not len(i):
        return none, none, none, none
    # one root of each run and end
    by = np.lexsort((i, p, i + right))
    i, p, right = i[by], p[by], right[by]
    one = np.concatenate([[True], (p[1:] != p[:-1]) | ((i + right)[1:] != (i + right)[:-1])])
    i, p, right = i[one], p[one], right[one]
    left = _agree_before(s, first, row, i, p)
    r, start, length = row[i], i - left - first[row[i]], left + p + right
    keep = length >= np.maximum(least, repeats * p)
    out = np.unique(np.stack([r[keep], start[keep], p[keep], length[keep]], 1), axis=0)
    return out[:, 0], out[:, 1], out[:, 3], out[:, 2]


def _again(level: np.ndarray, row: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places whose number at ``level`` comes again later in the same row."""
    by = np.lexsort((np.arange(len(level)), level))
    same = (level[by][1:] == level[by][:-1]) & (row[by][1:] == row[by][:-1])
    return np.sort(by[:-1][same])


def _agree_before(s: np.ndarray, first: np.ndarray, row: np.ndarray, i: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Numbers that are equal before ``i`` and ``i + p``, from the reversed texts of those rows."""
    rows = np.unique(row[i])
    sizes = first[rows + 1] - first[rows] - 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    forward = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
    ids = s[np.repeat(first[rows + 1] - 2, sizes) - forward]
    back, start = with_sentinels(np.unique(ids, return_inverse=True)[1], bounds)
    at = np.searchsorted(rows, row[i])
    end = start[at + 1] - 1 - (i - first[row[i]])  # where i itself would be, read backwards, and one more
    return Suffixes(back).agree(end, end - p).astype(np.int64)


def periodic_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text that the query makes periodic; None where it stays."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _describe(c: T.Chunk, doc_ids: list, planted: bool, least: int, repeats: int) -> list[dict]:
    start, end, row = T.spans(c.buf, c.offs, T.SPACED)
    at = T.per_row(row, c.rows)
    ids = word_ids(c.buf, start, end, T.SPACED) if len(start) else np.zeros(0, np.int64)
    if planted:
        source = np.arange(len(start))
        for r, doc in enumerate(doc_ids):
            moved = periodic_words(doc, int(at[r + 1] - at[r]))
            if moved is not None:
                source[at[r] : at[r + 1]] = at[r] + moved
        start, end, ids = start[source], end[source], ids[source]
    r, begin, length, period = find_runs(ids, at, least, repeats)
    # a word goes if it lies after the first period of any run
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, at[r] + begin + period, 1)
    np.add.at(change, at[r] + begin + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    joined, place = T.joined(c.buf, start[kept], end[kept])
    upto = np.concatenate([[0], np.cumsum(kept)])[at]
    bounds, text = np.searchsorted(r, np.arange(c.rows + 1)), memoryview(joined)
    out = []
    for k, doc in enumerate(doc_ids):
        runs = list(zip(begin[bounds[k] : bounds[k + 1]].tolist(), length[bounds[k] : bounds[k + 1]].tolist(), period[bounds[k] : bounds[k + 1]].tolist(), strict=True))
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else (None, None, None)
        said = "".join(f"{a},{n},{q}\n" for a, n, q in sorted(runs, key=lambda x: (x[0], x[2])))
        lo, hi = int(upto[k]), int(upto[k + 1])
        words = text[place[lo] : place[hi] - 1] if hi > lo else b""
        out.append(
            {
                "doc_id": doc, "n_words": int(at[k + 1] - at[k]), "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
                "exponent_milli": 1000 * best[1] // best[2] if runs else None, "runs_sha256": hashlib.sha256(said.encode()).hexdigest(),
                "collapsed_sha256": hashlib.sha256(words).hexdigest(), "n_dropped": int(at[k + 1] - at[k]) - (hi - lo),
                "runs": [{"start": a, "length": n, "period": q} for a, n, q in runs],
            }
        )
    return out


def detect(docs: DataFrame, planted: bool = False, least: int = LEAST_LENGTH, repeats: int = LEAST_REPEATS) -> DataFrame:
    """Per row of ``docs``: the number of runs, the one that repeats most, all runs, and digests of the runs and of the text without repeats.

    ``planted`` makes the texts of a tenth of the documents periodic first, as ``periodic_words`` says.
    """
    arrow = pa.schema(
        [(k, pa.int64()) for k in ("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli")]
        + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("n_dropped", pa.int64())]
        + [("runs", pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])))]
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = batch.column("doc_id").to_pylist(), []
        for c in T.chunks(batch.column("text")):
            rows += _describe(c, ids[c.lo : c.hi], planted, least, repeats)
        return pa.RecordBatch.from_pylist(rows, arrow)

    return T.by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA)


def brute_force(words: list, least: int = LEAST_LENGTH, repeats: int = LEAST_REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by trying every period, for tests."""
    ids = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.zeros(0, int)
    n, out = len(ids), []
    for q in range(1, n // repeats + 1):
        equal = np.concatenate([[0], (ids[q:] == ids[:-q]).astype(int), [0]])
        edge = np.diff(equal)
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            length = int(b - a + q)
            if length >= max(least, repeats * q) and not any(x <= a and x + m >= a + length for x, m, _ in out):
                out.append((int(a), length, q))
    return sorted(out, key=lambda x: (x[0], x[2]))
