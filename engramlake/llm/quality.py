"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from whole texts, in tasks; the trees are fitted on the driver, on a bounded
sample of labelled rows (a matrix of some 20 numbers a row), and sent as flat arrays.

Edge cases: null and empty texts have statistics of zero and a score like any other; labels that
are null or whose document is missing teach nothing; of repeated labels each counts; without labels
every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm import gbt
from engramlake.llm import text as T

#: Bound of the labelled sample that a model is fitted on.
TRAIN_ROWS = 20_000

_KINDS = ("lower", "upper", "digit", "space", "newline", "stop", "comma", "pipe", "mark", "symbol", "quote", "other", "beyond")
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "longest_word", "letters", "upper", "digit", "newline", "stop", "comma", "pipe", "mark", "symbol", "quote", "other", "beyond",
    "distinct", "top_word", "same_as_last", "repeated_trigrams", "short_words", "line_words", "repeated_lines", "odd_words",
)


def _kind(b: int) -> int:
    c = chr(b)
    if b >= 0x80:
        return _KINDS.index("beyond")
    for name, those in (("newline", "\n"), ("space", " \t\r\v\f"), ("stop", ".;:"), ("comma", ","), ("pipe", "|"), ("mark", "!?"), ("symbol", "#$%&*<>@^~_=+/\\{}[]"), ("quote", "\"'`()-")):
        if c in those:
            return _KINDS.index(name)
    return _KINDS.index("lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "other")


_KIND = np.array([_kind(b) for b in range(256)])


def _runs(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row, of items with hash h: distinct ones, the most frequent one's count, items that occur again."""
    if not len(h):
        z = np.zeros(rows)
        return z, z, z
    order = np.lexsort((h, row))
    s, r = h[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(s)))
    top = np.zeros(rows)
    np.maximum.at(top, r[first], n)
    return np.bincount(r[first], minlength=rows), top, np.bincount(r[first], weights=np.where(n > 1, n, 0), minlength=rows)


def statistics(c: T.Chunk) -> np.ndarray:
    """A row of FEATURES for each text of a chunk."""
    n = c.rows
    size = np.diff(c.offs)
    of_byte = np.repeat(np.arange(n), size)
    kinds = np.bincount(of_byte * len(_KINDS) + _KIND[c.buf], minlength=n * len(_KINDS)).reshape(n, len(_KINDS)).astype(float)
    kind = dict(zip(_KINDS, kinds.T, strict=True))
    start, end, row = T.spans(c.buf, c.offs, T.SPACED)
    words, at = np.bincount(row, minlength=n).astype(float), T.per_row(row, n)
    out = np.zeros((n, len(FEATURES)))
    put = lambda name, v: out.__setitem__((slice(None), FEATURES.index(name)), v)
    b, w = np.maximum(size, 1), np.maximum(words, 1)
    letters = kind["lower"] + kind["upper"] + kind["beyond"]
    put("log_bytes", np.log1p(size))
    put("log_words", np.log1p(words))
    put("letters", letters / b)
    put("upper", kind["upper"] / np.maximum(kind["lower"] + kind["upper"], 1))
    for k in ("digit", "newline", "stop", "comma", "pipe", "mark", "symbol", "quote", "other", "beyond"):
        put(k, kind[k] / b)
    if not len(start):
        return out
    long = end - start
    h = T.Hasher(c.buf)(start, end)
    longest = np.zeros(n)
    np.maximum.at(longest, row, long)
    put("word_bytes", T.sums(long, at) / w)
    put("longest_word", np.log1p(longest))
    distinct, top, _ = _runs(h, row, n)
    put("distinct", distinct / w)
    put("top_word", top / w)
    same = np.zeros(len(h), np.int64)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    put("same_as_last", T.sums(same, at) / w)
    g = T.mix(T.mix(h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:]) if len(h) > 2 else h[:0]
    ok = row[:-2] == row[2:] if len(h) > 2 else row[:0] == 0
    put("repeated_trigrams", _runs(g[ok], row[:-2][ok] if len(h) > 2 else row[:0], n)[2] / w)
    put("short_words", T.sums((long <= 3).astype(np.int64), at) / w)
    last = _KIND[c.buf[end - 1]]
    put("odd_words", T.sums(np.isin(last, [_KINDS.index(x) for x in ("symbol", "pipe", "mark")]).astype(np.int64), at) / w)
    ls, le, lr = T.spans(c.buf, c.offs, T.byte_set(lambda x: x != 0x0A))
    lines = np.maximum(np.bincount(lr, minlength=n), 1)
    put("line_words", np.log1p(words / lines))
    put("repeated_lines", _runs(T.Hasher(c.buf)(ls, le), lr, n)[2] / lines)
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the statistics in the order of FEATURES."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.concatenate([statistics(c) for c in T.chunks(batch.column("text"))])
        lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    return T.by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id bigint, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, target: str, max_rows: int = TRAIN_ROWS) -> gbt.Forest:
    """Trees for the 0/1 column ``target`` of ``labels`` (doc_id), fitted on at most about ``max_rows`` rows."""
    labels = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("double").alias("y"))
    some = T.stored(T.bounded(labels, max_rows, "doc_id"))
    seen = features(T.with_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), some, "left_semi")).join(some, "doc_id")
    rows = seen.select("x", "y", "doc_id").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist()).reshape(len(rows), len(FEATURES))
    return gbt.fit(x, rows["y"].to_numpy(float))


def score(docs: DataFrame, model: gbt.Forest) -> DataFrame:
    """doc_id and score: the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = np.concatenate([sent.value.score(statistics(c)) for c in T.chunks(batch.column("text"))])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return T.by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id bigint, score double")
