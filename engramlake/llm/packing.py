"""Best-fit packing of token sequences by patterns fitted with non-negative least squares.

1. Each document is tokenized once, in tasks; longer ones are cut. Only lengths go on.
2. The histogram of piece lengths (at most ``capacity`` numbers) decides the plan on the driver:
   patterns of a few lengths that fill a sequence are enumerated, their repeat counts are fitted to
   the histogram by non-negative least squares, from even counts, and rounded. What that leaves is
   enumerated and fitted again, until a fifth of the pieces is left; that residual is packed by best fit.
3. Pieces of one length are numbered across the corpus by counts over hash buckets, and the number
   finds the place in the plan. No group of pieces is ever together in one task.

Edge cases: null text is empty and makes one piece with the end token alone; repeated rows are
packed once each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.llm import text as T

CAPACITY = 2048
END_TOKEN = 0
#: Pieces of about as many rows are numbered together.
BUCKET_ROWS = 50_000
#: Lengths of a pattern at most (for long and for short pieces), patterns enumerated for each longest length, how full they are at least,
#: and the share of pieces that is left to best fit.
PATTERN_LENGTHS, VARIANTS, LEAST_FILL, RESIDUAL = (6, 64), 16, 0.998, 0.2


def tokenizer_path(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """The public vocabulary for the tokenizers library, and the same as ranks."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


@lru_cache(2)
def encoder(json_path: str, ranks_path: str | None):
    """Text to ids as the tokenizers library gives them.

    With ranks, tiktoken encodes Latin-1 text, which gives equal ids in a quarter of the time; text
    beyond Latin-1 (whose character classes depend on a library's Unicode version) and text that may
    hold a special token goes to tokenizers itself.
    """
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    @lru_cache(1)
    def slow() -> Tokenizer:  # read only where a text needs it
        return Tokenizer.from_file(json_path)

    fast = None
    if ranks_path:
        import public_tokenizers

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if fast and "<|" not in text:
            try:
                text.encode("latin-1")
                return fast.encode_ordinary(text)
            except UnicodeEncodeError:
                pass
        return slow().encode(text, add_special_tokens=False).ids

    return encode


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Pieces (start, length) of n tokens: whole ones, and a shorter first one."""
    rest = n % capacity if n > capacity else n
    first = [(0, rest)] if rest else []
    return first + [(s, capacity) for s in range(rest, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_token: int = END_TOKEN, paths: tuple[str, str | None] | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    paths = paths or tokenizer_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(*paths)
        ids, out = iter(batch.column("doc_id").to_pylist()), ([], [], [], [], [])
        for texts in T.slices(batch):
            done: dict[str, list] = {}  # copies beside each other are encoded once
            for t in texts:
                i, t = next(ids), t or ""
                if t not in done:
                    a = np.array([*encode(t), end_token], "<u4")
                    done[t] = [(k, s, n, zlib.crc32(a[s : s + n].tobytes())) for k, (s, n) in enumerate(cuts(len(a), capacity))]
                for p in done[t]:
                    for x, y in zip(out, (i, *p), strict=True):
                        x.append(y)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return T.by_batch(read, run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


Plan = list[tuple[tuple[int, ...], int]]


def best_fit(hist: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing on a histogram of lengths, equal bins handled together."""
    left = hist.copy()
    open_bins: dict[int, dict[tuple, int]] = defaultdict(dict)  # by room left
    full: dict[tuple, int] = {}
    rooms = np.zeros(capacity + 1, bool)
    for n in range(capacity, 0, -1):
        c = int(left[n])
        while c:
            fits = np.flatnonzero(rooms[n:])
            if len(fits):
                room = n + int(fits[0])
                pattern, have = open_bins[room].popitem()
                k = min(c, have)
                if have > k:
                    open_bins[room][pattern] = have - k
                rooms[room] = bool(open_bins[room])
                grown, now = (*pattern, n), room - n
            else:  # new bins, each with as many of this length as it takes
                take = min(c, capacity // n)
                k = c // take
                grown, now = (n,) * take, capacity - n * take
                bins = open_bins[now] if now else full
                bins[grown] = bins.get(grown, 0) + k
                rooms[now] = now > 0
                c -= k * take
                continue
            bins = open_bins[now] if now else full
            bins[grown] = bins.get(grown, 0) + k
            if now:
                rooms[now] = True
            c -= k
    for bins in open_bins.values():
        for p, k in bins.items():
            full[p] = full.get(p, 0) + k
    return list(full.items())


def enumerate_patterns(hist: np.ndarray, capacity: int, turn: int = 0, least: int = 1, variants: int = VARIANTS, fill: float = LEAST_FILL) -> list[tuple[int, ...]]:
    """Patterns of a few occurring lengths that fill a sequence, or nearly: some for each longest length from ``least`` on.

    The places after the longest one take lengths at spread places of the histogram, and the last one the longest
    that still fits. Another ``turn`` gives other patterns.
    """
    have = np.flatnonzero(hist[: capacity + 1])
    have = have[have > 0]
    upto = np.concatenate([[0], np.cumsum(hist[have])])
    mean = (hist[have] * have).sum() / max(1, hist[have].sum())
    lengths = max(PATTERN_LENGTHS[0], min(PATTERN_LENGTHS[1], int(np.ceil(1.5 * capacity / max(mean, 1)))))
    found: set[tuple[int, ...]] = set()
    for i, n in enumerate(have[have >= least][::-1].tolist()):
        for v in range(variants):
            pattern, room = [n], capacity - n
            while len(pattern) < lengths:
                k = int(np.searchsorted(have, min(room, n), "right"))
                if not k:
                    break
                most = int(have[k - 1])
                at = ((v + 1 + turn) * 0.6180339887 + i * 0.7548776662 + len(pattern) * 0.5698402910) % 1.0  # evenly spread over any number of turns
                some = int(have[int(np.searchsorted(upto, at * upto[k], "right")) - 1])
                if v == 0 or len(pattern) == lengths - 1 or room - some < have[0]:
                    some = most
                pattern.append(some)
                room -= some
            if room <= (1 - fill) * capacity:
                found.add(tuple(sorted(pattern, reverse=True)))
    return sorted(found, reverse=True)


def fit_repeats(patterns: list[tuple[int, ...]], hist: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares of pattern counts to the histogram, from even counts, by scaled gradient steps that stay positive."""
    rows = np.concatenate([np.array(p) for p in patterns])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    h = hist.astype(float)
    x = np.full(len(patterns), h.sum() / len(rows))
    target = np.bincount(cols, weights=h[rows], minlength=len(patterns))
    for _ in range(rounds):
        made = np.bincount(rows, weights=x[cols], minlength=len(h))
        x *= target / np.maximum(np.bincount(cols, weights=made[rows], minlength=len(patterns)), 1e-12)
    return x


def fitted_patterns(hist: np.ndarray, capacity: int) -> tuple[Plan, np.ndarray]:
    """Patterns with repeat counts, and the histogram of what they leave over.

    Patterns are enumerated, their counts are fitted and rounded down (where that takes too little, rounded, and
    at last up), as far as pieces last, those of the longest pieces first; then the same for what is left, until
    that is at most ``RESIDUAL`` of all pieces or no pattern fills a sequence.
    """
    left, plan, turn, lengths = hist.copy(), {}, 0, np.arange(len(hist))
    while left.sum() > RESIDUAL * hist.sum():
        # pieces of more than half a sequence need one each, so theirs are filled before any without
        patterns = enumerate_patterns(left, capacity, turn, capacity // 2 + 1) or enumerate_patterns(left, capacity, turn)
        if not patterns:
            break
        turn += VARIANTS
        fitted, taken = fit_repeats(patterns, left), 0
        order = np.lexsort((-fitted, [-p[0] for p in patterns]))
        for more in (0.0, 0.5, 1.0):
            for j in order:
                n, need = np.unique(patterns[j], return_counts=True)
                k = int(min(np.floor(fitted[j] + more), (left[n] // need).min()))
                if k > 0:
                    plan[patterns[j]] = plan.get(patterns[j], 0) + k
                    left[n] -= k * need
                    taken += k
            if taken * capacity >= 0.05 * (left * lengths).sum():
                break
        if not taken:
            break
    return list(plan.items()), left


def plan_patterns(hist: np.ndarray, capacity: int) -> Plan:
    """Patterns with repeat counts that use up the histogram: fitted ones, and best fit for the residual."""
    plan, left = fitted_patterns(hist, capacity)
    return plan + best_fit(left, capacity)


def slots(plan: Plan) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, last number + 1, first sequence, offset): where pieces of a length go by their number."""
    used: dict[int, int] = defaultdict(int)
    out, base = [], 0
    for pattern, k in plan:
        offset = 0
        for n in pattern:
            out.append((n, used[n], used[n] + k, base, offset))
            used[n] += k
            offset += n
        base += k
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, end_token: int = END_TOKEN, paths: tuple[str, str | None] | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark: SparkSession = docs.sparkSession
    cut = T.stored(pieces(docs, capacity, end_token, paths))
    lengths = cut.groupBy("length").count().collect()  # at most ``capacity`` rows
    hist = np.zeros(capacity + 1, np.int64)
    for n, c in lengths:
        hist[n] = c
    schema = "length bigint, lo bigint, hi bigint, base bigint, offset bigint"
    places = spark.createDataFrame(slots(plan_patterns(hist, capacity)), schema)
    buckets = max(8, int(hist.sum()) // BUCKET_ROWS)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)))
    sizes = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    # whole copies of a row share a bucket, and a number is needed for each, so ties may fall either way
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = cut.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("number", F.col("within") + F.col("before"))
    # the plan has a few thousand rows, as lengths are bounded by the capacity
    n, p = numbered.alias("n"), F.broadcast(places).alias("p")
    at = n.join(p, (F.col("n.length") == F.col("p.length")) & (F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi")))
    return at.select("n.doc_id", "n.piece", "n.start", "n.length", "n.ids_crc32", (F.col("base") + F.col("number") - F.col("lo")).alias("sequence_id"), F.col("p.offset").alias("offset"))
