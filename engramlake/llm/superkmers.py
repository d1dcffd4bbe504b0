"""Removal of word windows that other documents hold too, by super-k-mers in minimiser buckets.

1. Of the word 3-grams of each window of 13 words the one with the least hash is its minimiser.
   Consecutive windows of a document with one minimiser are a super-k-mer: they travel as one packed
   string of words, so each word is sent about three times instead of thirteen. Equal windows have equal
   minimisers and so meet in one bucket.
2. A first pass counts bytes by hash cells of minimisers. Cells next to each other make buckets of
   about equal size from these counts.
3. A task packs what it has for a bucket into one compressed row. In the bucket, windows are sorted by
   hash, neighbours are compared byte by byte, and the least doc_id of equal windows decides.
   Occurrences in documents with greater ids give ranges of words to remove.
4. A cell that holds more than a bucket may (a line or passage in very many documents) is no bucket:
   its windows are counted one by one, by a sum that is made before the shuffle, and a join, whose hot
   keys are dealt to several tasks, brings the least doc_id to the occurrences.
5. Ranges meet the texts by doc_id; covered words go. Texts that lose nothing stay where they are.

Windows are judged on the input. The map from cells to buckets and the counts behind it are all that
the driver holds, at most 2^20 numbers; cells come in finer grain as the table grows to that bound.

Edge cases: null text has no words; texts of fewer than 13 words have no window and stay whole; a window
that comes twice in one document, or in rows that share a doc_id, is no copy of itself; a row without a
doc_id neither loses words nor takes any from others; very long texts travel in pieces of at most 256
windows; empty tables give no rows; further columns are ignored, or kept by ``remove``.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm import text as T

WINDOW = 13
#: Words of a minimiser.
GRAM = 3
#: Windows of one packed string at most.
LONGEST = 256
#: Packed bytes of a bucket, about; of a larger cell the windows are counted one by one.
BUCKET_BYTES = 8 << 20
#: Bytes of texts that a task packs together.
PACK_BYTES = 2 << 20
PACKS = 8
MOST_CELLS = 20
_K = np.uint64(0xA24BAED4963EE407)


def word_hashes(c: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of each word."""
    start, end, row = T.spans(c.buf, c.offs, T.SPACED)
    return start, end, row, T.Hasher(c.buf, lower=False)(start, end) if len(start) else np.zeros(0, np.uint64)


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([x[k:], np.full(min(k, len(x)), ~np.uint64(0))])[: len(x)]


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` words from each word on; the last ones mean nothing."""
    out, width = h, 1
    while 2 * width <= k:
        out, width = T.mix(out * _K + _ahead(out, width)), 2 * width
    return out if width == k else T.mix(out * _K + _ahead(out, k - width) + np.uint64(k))


def least_ahead(x: np.ndarray, k: int) -> np.ndarray:
    """The least of the ``k`` values from each one on."""
    out, width = x, 1
    while 2 * width <= k:
        out, width = np.minimum(out, _ahead(out, width)), 2 * width
    return out if width == k else np.minimum(out, _ahead(out, k - width))


@dataclass
class Packed:
    """Super-k-mers of a chunk: row, first word in the row, spread minimiser, and where its words lie in ``buf``, one space between them."""

    row: np.ndarray
    first: np.ndarray
    key: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    buf: np.ndarray


def super_kmers(c: T.Chunk, window: int = WINDOW) -> Packed:
    start, end, row, h = word_hashes(c)
    at, n = T.per_row(row, c.rows), len(h)
    gram = min(GRAM, window)
    least = least_ahead(run_hashes(h, gram), window - gram + 1)
    w = np.flatnonzero(np.arange(n) + window <= at[1:][row]) if n else np.zeros(0, np.int64)
    buf, place = T.joined(c.buf, start, end)
    if not len(w):
        z = np.zeros(0, np.int64)
        return Packed(z, z, np.zeros(0, np.uint64), z, z, buf)
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1] + 1) | (row[w[1:]] != row[w[:-1]]) | (least[w[1:]] != least[w[:-1]])
    since = np.arange(len(w)) - np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
    new |= since % LONGEST == 0
    a = np.flatnonzero(new)
    b = np.concatenate([a[1:], [len(w)]]) - 1
    first = w[a]
    return Packed(row[first], first - at[row[first]], T.mix(least[first] ^ np.uint64(0x9E3779B97F4A7C15)), place[first], place[w[b] + window] - 1, buf)


def _cells(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and copy: 0, or, where rows share a doc_id, a hash that tells them apart."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    again = rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    return rows.withColumn("copy", F.lit(0) if again.isEmpty() else F.xxhash64("text").bitwiseAND(F.lit(2**31 - 1)).cast("int"))


def cell_bytes(rows: DataFrame, bits: int, window: int) -> np.ndarray:
    """Packed bytes of each cell over all rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for c in T.chunks(batch.column("text")):
                found = super_kmers(c, window)
                total += np.bincount(_cells(found.key, bits), found.end - found.begin, 1 << bits).astype(np.int64)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "bytes"])

    found = T.small_batches(rows.select("text")).mapInArrow(run, "cell bigint, bytes bigint").groupBy("cell").agg(F.sum("bytes").alias("bytes")).toArrow()
    out = np.zeros(1 << bits, np.int64)
    out[found["cell"].to_numpy()] = found["bytes"].to_numpy()
    return out


def deal(cells: np.ndarray, most: int) -> np.ndarray:
    """A bucket for each cell, of about ``most`` bytes; -1 for a cell that is larger alone."""
    hot = cells > most
    filled = np.cumsum(np.where(hot, 0, cells))
    return np.where(hot, -1, filled // most).astype(np.int32)


def _pack(doc: np.ndarray, copy: np.ndarray, first: np.ndarray, size: np.ndarray, words: bytes) -> bytes:
    raw = b"".join([np.int64(len(doc)).tobytes(), doc.astype("<i8").tobytes(), copy.astype("<i4").tobytes(), first.astype("<i8").tobytes(), size.astype("<i4").tobytes(), words])
    return np.int64(len(raw)).tobytes() + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], int(np.frombuffer(blob, "<i8", 1)[0]), asbytes=True)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for kind, width in (("<i8", 8), ("<i4", 4), ("<i8", 8), ("<i4", 4)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += width * n
    return (*out, np.frombuffer(raw, np.uint8, offset=at))


def _gather(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one after the other."""
    size = end - begin
    at = np.concatenate([[0], np.cumsum(size)])
    return buf[np.arange(int(at[-1])) + np.repeat(begin - at[:-1], size)]


def packed(rows: DataFrame, buckets: np.ndarray, window: int) -> DataFrame:
    """bucket, blob: the super-k-mers of some texts for that bucket."""
    bits = len(buckets).bit_length() - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = defaultdict(list)
        n = 0

        def out() -> pa.RecordBatch:
            keys = sorted(held)
            blobs = [_pack(*(np.concatenate([x[i] for x in held[k]]) for i in range(4)), b"".join(x[4] for x in held[k])) for k in keys]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for batch in batches:
            ids, copies = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("copy").to_numpy(zero_copy_only=False)
            for c in T.chunks(batch.column("text"), PACK_BYTES):
                found = super_kmers(c, window)
                bucket = buckets[_cells(found.key, bits)]
                order = np.argsort(found.key)
                order = order[bucket[order] >= 0]
                bucket, size = bucket[order], (found.end - found.begin)[order]
                words = _gather(found.buf, found.begin[order], found.end[order]).tobytes()
                upto = np.concatenate([[0], np.cumsum(size)])
                row, first = found.row[order] + c.lo, found.first[order]
                doc, copy = ids[row], copies[row]
                cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else [0]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    held[int(bucket[a])].append((doc[a:b], copy[a:b], first[a:b], size[a:b], words[upto[a] : upto[b]]))
                n += 1
                if n % PACKS == 0 and held:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return T.small_batches(rows.filter("doc_id is not null")).mapInArrow(run, "bucket int, blob binary")


def _equal(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, limit: int = 1 << 21) -> np.ndarray:
    """Whether the ``size`` bytes at ``a`` and at ``b`` are the same, some bytes at a time."""
    out, lo, upto = np.ones(len(a), bool), 0, np.concatenate([[0], np.cumsum(size)])
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + limit, "right")) - 1)
        differ = _gather(buf, a[lo:hi], a[lo:hi] + size[lo:hi]) != _gather(buf, b[lo:hi], b[lo:hi] + size[lo:hi])
        starts = upto[lo:hi] - upto[lo]
        out[lo:hi] = np.add.reduceat(differ, starts) == 0
        lo = hi
    return out


def shared_windows(buf: np.ndarray, offs: np.ndarray, doc: np.ndarray, window: int = WINDOW, hashes=run_hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mer, and first and last window in it, of the stretches whose windows start in a document with a smaller id too.

    The words of super-k-mer ``k`` are the bytes ``offs[k]`` to ``offs[k + 1]``.
    """
    parts = []
    lo = 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + T.CHUNK_BYTES, "right")) - 1)
        start, end, row, h = word_hashes(T.Chunk(lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]))
        parts.append((start + offs[lo], end + offs[lo], row + lo, h))
        lo = hi
    none = np.zeros(0, np.int64)
    if not parts:
        return none, none, none
    start, end, row, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    at = T.per_row(row, len(offs) - 1)
    w = np.flatnonzero(np.arange(len(h)) + window <= at[1:][row])
    key = hashes(h, window)[w]
    by = np.argsort(key, kind="stable")
    same = key[by][1:] == key[by][:-1]
    grouped = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    if not grouped.any():
        return none, none, none
    by, head = by[grouped], ~np.concatenate([[False], same])[grouped]
    group = np.cumsum(head) - 1
    begin, size = start[w[by]], end[w[by] + window - 1] - start[w[by]]
    first = np.flatnonzero(head)[group]
    alike = size == size[first]
    at_alike = np.flatnonzero(alike)
    alike[at_alike] = _equal(buf, begin[at_alike], begin[first[at_alike]], size[at_alike])
    if not alike.all():  # different windows of one hash: told apart by their words
        names: dict[tuple[int, bytes], int] = {}
        odd = np.isin(group, group[~alike])
        for k in np.flatnonzero(odd):
            group[k] = len(head) + names.setdefault((int(group[k]), buf[begin[k] : begin[k] + size[k]].tobytes()), len(names))
        order = np.argsort(group, kind="stable")
        by, group = by[order], group[order]
        group = np.cumsum(np.concatenate([[False], group[1:] != group[:-1]]))
    of = doc[row[w[by]]]
    cut = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
    least = np.repeat(np.minimum.reduceat(of, cut), np.diff(np.concatenate([cut, [len(of)]])))
    taken = np.sort(w[by[of > least]])
    if not len(taken):
        return none, none, none
    new = np.concatenate([[True], (taken[1:] != taken[:-1] + 1) | (row[taken[1:]] != row[taken[:-1]])])
    a = np.flatnonzero(new)
    b = np.concatenate([a[1:], [len(taken)]]) - 1
    k = row[taken[a]]
    return k, taken[a] - at[k], taken[b] - at[k]


_RANGES = "doc_id bigint, copy int, first bigint, last bigint"


def _count(window: int, blobs: pa.Table) -> pa.Table:
    parts = [_unpack(b.as_py()) for b in blobs.column("blob")]
    doc, copy, first, size, buf = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    k, a, b = shared_windows(buf, np.concatenate([[0], np.cumsum(size)]), doc, window)
    return pa.table({"doc_id": doc[k].astype(np.int64), "copy": copy[k].astype(np.int32), "first": first[k] + a, "last": first[k] + b + window})


def hot_windows(rows: DataFrame, hot: np.ndarray, window: int) -> DataFrame:
    """words, doc_id, copy, first: each window whose minimiser is of a hot cell."""
    bits = len(hot).bit_length() - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("copy").to_numpy(zero_copy_only=False)
            for c in T.chunks(batch.column("text")):
                start, end, row, h = word_hashes(c)
                at = T.per_row(row, c.rows)
                gram = min(GRAM, window)
                least = least_ahead(run_hashes(h, gram), window - gram + 1)
                w = np.flatnonzero(np.arange(len(h)) + window <= at[1:][row]) if len(h) else np.zeros(0, np.int64)
                w = w[hot[_cells(T.mix(least[w] ^ np.uint64(0x9E3779B97F4A7C15)), bits)]]
                if not len(w):
                    continue
                buf, place = T.joined(c.buf, start, end)
                begin, stop = place[w], place[w + window] - 1
                offs = np.concatenate([[0], np.cumsum(stop - begin)]).astype(np.int32)
                words = pa.Array.from_buffers(pa.string(), len(w), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(_gather(buf, begin, stop).tobytes())])
                yield pa.RecordBatch.from_arrays([words, pa.array(ids[row[w] + c.lo]), pa.array(copies[row[w] + c.lo]), pa.array(w - at[row[w]])], ["words", "doc_id", "copy", "first"])

    return T.small_batches(rows.filter("doc_id is not null")).mapInArrow(run, "words string, doc_id bigint, copy int, first bigint")


def ranges(rows: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, copy, first, last (not included): ranges of words whose windows start in a document with a smaller id too. ``rows``: doc_id, text, copy."""
    n = rows.count()
    bits = min(MOST_CELLS, max(12, (n // 64).bit_length()))
    cells = cell_bytes(rows, bits, window)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # several buckets for each task, so that no task is far larger than another
    buckets = deal(cells, int(max(1 << 14, min(bucket_bytes, cells.sum() // (4 * tasks)))))
    found = packed(rows, buckets, window).groupBy("bucket").applyInArrow(lambda t: _count(window, t), _RANGES)
    if (buckets >= 0).all():
        return found
    each = T.stored(hot_windows(rows, buckets < 0, window))
    least = T.stored(each.groupBy("words").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("words", "least"))
    more = each.join(least, "words").filter("doc_id > least").select("doc_id", "copy", "first", (F.col("first") + window).alias("last"))
    return found.unionByName(more)


def _kept(c: T.Chunk, taken: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words that stay, one space between; where each row's start in them; words of each row, and those that stay."""
    start, end, row = T.spans(c.buf, c.offs, T.SPACED)
    at = T.per_row(row, c.rows)
    lists = pc.list_parent_indices(taken).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(taken)
    first, last = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("first", "last"))
    change = np.zeros(len(start) + 1, np.int64)
    np.add.at(change, at[lists] + first, 1)
    np.add.at(change, at[lists] + last, -1)
    kept = np.cumsum(change[:-1]) == 0
    buf, place = T.joined(c.buf, start[kept], end[kept])
    upto = np.concatenate([[0], np.cumsum(kept)])[at]
    return buf, place[upto], np.diff(at), np.diff(upto)


def remove(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_text (the words that stay, one space between), kept_sha256."""
    rows = _rows(docs)
    taken = T.stored(ranges(rows, window, bucket_bytes).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("first", "last")).alias("taken")))
    none = F.expr("cast(array() as array<struct<first: bigint, last: bigint>>)")
    # texts that lose nothing are not shuffled, as long as the ids of the others are few enough to be sent to all tasks
    touched = taken.select("doc_id").distinct()
    if touched.count() <= T.BROADCAST_IDS:
        some = rows.join(F.broadcast(touched), "doc_id", "left_semi").join(taken, ["doc_id", "copy"], "left")
        rest = rows.join(F.broadcast(touched), "doc_id", "left_anti").withColumn("taken", none)
        with_ranges = some.select("doc_id", "text", "taken").unionByName(rest.select("doc_id", "text", "taken"))
    else:
        with_ranges = rows.join(taken, ["doc_id", "copy"], "left")
    with_ranges = with_ranges.select("doc_id", "text", F.coalesce("taken", none).alias("taken"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, removed, texts, digests = [], [], [], []
        for c in T.chunks(batch.column("text")):
            buf, place, words, kept = _kept(c, batch.column("taken").slice(c.lo, c.rows))
            view = memoryview(buf)
            for k in range(c.rows):
                said = bytes(view[place[k] : place[k + 1] - 1]) if kept[k] else b""
                texts.append(said.decode("utf-8", "replace"))
                digests.append(hashlib.sha256(said).hexdigest())
            n.append(words)
            removed.append(words - kept)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.concatenate(n)), pa.array(np.concatenate(removed)), pa.array(texts, pa.string()), pa.array(digests, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
        )

    return T.by_batch(with_ranges, run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string")


#: doc_id, n_words, n_removed and kept_sha256 over all documents, for DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (
  SELECT doc_id, w[i] AS word, i, CASE WHEN i + 12 <= len(w) THEN array_to_string(w[i:i + 12], ' ') END AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
m AS (SELECT words, min(doc_id) AS least FROM k WHERE words IS NOT NULL GROUP BY words HAVING min(doc_id) < max(doc_id)),
f AS (SELECT k.doc_id, word, i, coalesce(k.doc_id > least, false) AS shared FROM k LEFT JOIN m ON k.words = m.words),
c AS (SELECT doc_id, word, i, bool_or(shared) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
