"""Words, hashes and code points of Arrow string columns, as numpy arrays.

The operators see a partition as Arrow batches. ``chunks`` cuts a batch into runs of whole rows
of a bounded number of bytes (a longer text is a run of its own), and the functions below work on
such a run without a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.session import stored  # noqa: F401  the operators take it from here

CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch of texts, where the session has Spark's default of 10,000.
BATCH_ROWS = 2000


@dataclass
class Chunk:
    """Rows ``lo`` to ``hi`` of a batch: UTF-8 bytes, and where each row starts in them."""

    lo: int
    hi: int
    buf: np.ndarray
    offs: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def text(self) -> str:
        return self.buf.tobytes().decode("utf-8", "replace")


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Runs of whole rows of at most ``limit`` bytes, or of one longer row. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def byte_set(keep: Callable[[int], bool]) -> np.ndarray:
    return np.array([keep(b) for b in range(256)])


#: Bytes of words after A-Z is lower-cased: 0-9, a-z and all beyond ASCII.
ALNUM = byte_set(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: Bytes of words that only ASCII white space parts.
SPACED = byte_set(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Letters of ASCII and all beyond it.
LETTERS = byte_set(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240501)
_CODE = _rng.integers(1, 2**64, 256, np.uint64, endpoint=False)
_CODE_LOWER = _CODE[LOWER]


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of any byte ranges of a chunk, from one running sum."""

    def __init__(self, buf: np.ndarray, lower: bool = True):
        n = len(buf) + 1
        self.pow, self.inv = _powers(1 << max(20, int(n).bit_length()))
        self.sum = np.zeros(n, np.uint64)
        np.cumsum((_CODE_LOWER if lower else _CODE)[buf] * self.pow[: n - 1], out=self.sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.inv[start] + (end - start).astype(np.uint64))


def spans(buf: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of member bytes inside a row."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = member[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    first = m.copy()
    first[1:] &= ~m[:-1] | edge[1:-1]
    last = m.copy()
    last[:-1] &= ~m[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte ranges one after the other, a space after each, and where each starts in that (with the end of all)."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    shift = np.repeat(start - at[:-1], size)
    to = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    out[to] = buf[to + shift]
    return out, at


def per_row(row: np.ndarray, n: int) -> np.ndarray:
    """Where each row's items start, for items in row order; n + 1 numbers."""
    return np.searchsorted(row, np.arange(n + 1))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between successive bounds; 0 where there are none."""
    c = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return c[bounds[1:]] - c[bounds[:-1]]


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session sends Arrow batches that suit rows with whole texts from now on."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) == 10_000:
        conf.set(key, str(BATCH_ROWS))
    return df


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` on each Arrow batch of ``df``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return small_batches(df).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str | int = "text") -> Iterator[list[str | None]]:
    """The texts of a batch as strings, in runs of a bounded number of bytes."""
    texts = batch.column(column)
    for c in chunks(texts):
        yield texts.slice(c.lo, c.rows).to_pylist()


def code_points(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a chunk, and where each row starts in them."""
    cps = np.frombuffer(c.text().encode("utf-32-le", "replace"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((c.buf & 0xC0) != 0x80)])
    return cps, lead[c.offs]


def crc_part(df: DataFrame, column: str, parts: int) -> Column:
    """crc32 of an id as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def bounded(df: DataFrame, most: int, key: str, rows: int | None = None) -> DataFrame:
    """At most about ``most`` rows, drawn by a hash of ``key``; all rows if there are no more. ``rows``: their number, where it is known.

    The share is a threshold over 63 bits of the hash, so it is as fine as any table is large.
    """
    n = df.count() if rows is None else rows
    if n <= most:
        return df
    return df.filter(F.xxhash64(F.lit(11), F.col(key)).bitwiseAND(F.lit(2**63 - 1)) < F.lit(2**63 * most // n))


#: Ids that a broadcast may hold: some 20 MB. More of them are joined by a shuffle.
BROADCAST_IDS = 500_000


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join by a shuffle on both sides, however small Spark takes them to be.

    It takes an exploded array for no larger than its file, and columns of which a file holds each value once for as small in memory as there,
    so it would send such tables whole through the driver.
    """
    return df.hint("merge")


def with_ids(df: DataFrame, ids: DataFrame, how: str, most: int = BROADCAST_IDS) -> DataFrame:
    """``df`` joined left_semi or left_anti with the doc_id of ``ids``, which should be stored; broadcast after a check of its size."""
    ids = ids.select("doc_id").distinct()
    return df.join(F.broadcast(ids) if ids.count() <= most else shuffled(ids), "doc_id", how)
