"""Quality rules by n-gram perplexity: a Kneser-Ney model that Spark counts over the whole corpus.

Spark counts the 4-grams of characters (code points as they are) of all documents per language,
summed in each batch before they are shuffled. The model (modified Kneser-Ney with three discounts,
interpolated down to single characters) is a table with a row for each distinct gram, made by joins
at one fixed order; it grows with the corpus. Documents are scored against ``SLICE`` grams at a
time, parted by a hash of the gram, and the sums of all slices added: memory stays bounded, a larger
model takes more passes, and the number of slices does not change what is measured. Each language's
band of perplexities reaches ``WIDTH`` interquartile ranges beyond the quartiles of its documents,
and documents outside are rejected, as are those that fail the base rules.

Edge cases: null text has no words and fails the base rule; documents without a language share one
band, ``und``; a language with few documents has a wide band, and one document is always inside.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm import text as T

ORDER = 4
#: Grams of the model that a scoring pass holds.
SLICE = 4_000_000
#: Interquartile ranges of log perplexity that a band reaches beyond the quartiles, least reach, and what the
#: mean of few symbols may vary beside, divided by the root of their number.
WIDTH, LEAST_WIDTH, SPREAD = 3.0, 0.1, 4.0
_CHARACTERS = 0x110000
_NAMES = ("a", "b", "c", "d")


def grams(c: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The characters (a row of ORDER code points) and the row of the gram that ends at each character; before a text stand line ends."""
    cps, offs = T.code_points(c)
    pad = ORDER - 1
    row = np.repeat(np.arange(c.rows), np.diff(offs))
    place = np.arange(len(cps)) + pad * (row + 1)
    s = np.full(len(cps) + pad * c.rows, 10, np.uint32)
    s[place] = cps
    return np.stack([s[place - k] for k in range(pad, -1, -1)], 1), row


def distinct(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``g``, and which of them each row is."""
    seen = np.zeros(_CHARACTERS, bool)
    seen[g] = True
    alphabet = np.flatnonzero(seen)
    if len(alphabet) > 0xFFFF:
        u, inverse = np.unique(g, axis=0, return_inverse=True)
        return u, inverse.ravel()
    of = np.zeros(_CHARACTERS, np.uint64)
    of[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    code = np.zeros(len(g), np.uint64)
    for k in range(ORDER):
        code = (code << np.uint64(16)) | of[g[:, k]]
    u, inverse = np.unique(code, return_inverse=True)
    shifts = np.arange(ORDER - 1, -1, -1, dtype=np.uint64) * np.uint64(16)
    return alphabet[(u[:, None] >> shifts) & np.uint64(0xFFFF)].astype(np.uint32), inverse


def _key(g: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of each gram."""
    h = np.zeros(len(g), np.uint64)
    for k in range(ORDER):
        h = T.mix(h * np.uint64(0xA24BAED4963EE407) + g[:, k].astype(np.uint64) + np.uint64(1))
    return h


def _read(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))


def counted(docs: DataFrame) -> DataFrame:
    """(lang, a, b, c, d, n): how often each gram of characters occurs in all rows of ``docs``."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang = np.array(batch.column("lang").to_pylist(), object)
        found: dict[str, tuple[list, list]] = {}
        for c in T.chunks(batch.column("text")):
            g, row = grams(c)
            here = lang[c.lo : c.hi]
            for x in set(here.tolist()):
                u, inverse = distinct(g[(here == x)[row]])
                of = found.setdefault(x, ([], []))
                of[0].append(u)
                of[1].append(np.bincount(inverse, minlength=len(u)))
        names, all_u, all_n = [], [np.zeros((0, ORDER), np.uint32)], [np.zeros(0, np.int64)]
        for x, (us, ns) in found.items():
            u, inverse = distinct(np.concatenate(us))
            names += [x] * len(u)
            all_u.append(u)
            all_n.append(np.bincount(inverse, weights=np.concatenate(ns), minlength=len(u)).astype(np.int64))
        u = np.concatenate(all_u).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array(u[:, k]) for k in range(ORDER)], pa.array(np.concatenate(all_n), pa.int64())], ["lang", *_NAMES, "n"])

    found = T.by_batch(_read(docs).select("lang", "text"), count, "lang string, a int, b int, c int, d int, n bigint")
    return found.groupBy("lang", *_NAMES).agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> DataFrame:
    """(lang, a, b, c, d, logp): of each gram that occurs in ``docs``, the log probability of its last character after the ones before it."""
    levels = [T.stored(counted(docs))]
    for k in range(1, ORDER):  # below the highest order: in how many grams a shorter one ends
        levels.append(T.stored(levels[-1].groupBy("lang", *_NAMES[k:]).agg(F.count("*").alias("n"))))
    p = None
    for k in range(ORDER - 1, -1, -1):
        level, names = levels[k], _NAMES[k:]
        of = level.groupBy("lang").agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"of{i}") for i in range(1, 5)])
        y = F.when(F.col("of1") > 0, F.col("of1") / (F.col("of1") + 2 * F.col("of2"))).otherwise(0.5)
        d = [F.when(F.col(f"of{i}") > 0, F.least(F.lit(float(i)), F.greatest(F.lit(0.1), i - (i + 1) * y * F.col(f"of{i + 1}") / F.nullif(F.col(f"of{i}"), F.lit(0.0))))).otherwise(0.5) for i in (1, 2, 3)]
        # one row for each language
        level = level.join(F.broadcast(of.select("lang", *[x.alias(f"d{i}") for i, x in enumerate(d, 1)])), "lang")
        level = level.select("lang", *names, "n", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")).alias("cut"))
        before = level.groupBy("lang", *names[:-1]).agg(F.sum("n").alias("total"), F.sum("cut").alias("cuts"))
        level = level.join(before, ["lang", *names[:-1]])
        lower = F.lit(1 / _CHARACTERS)
        if p is not None:
            level, lower = level.join(p, ["lang", *names[1:]]), F.col("p")
        gamma = F.greatest(F.col("cuts") / F.col("total"), F.lit(1e-9))
        p = T.stored(level.select("lang", *names, ((F.col("n") - F.col("cut")) / F.col("total") + gamma * lower).alias("p")))
    return p.select("lang", *_NAMES, F.log("p").alias("logp"))


def _rows(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items with hash h: whether an equal one of the same row came before, and whether there is any other."""
    order = np.lexsort((np.arange(len(h)), h, row))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    again, twice = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[order] = same
    both = same.copy()
    both[:-1] |= same[1:]
    twice[order] = both
    return again, twice


def base_counts(c: T.Chunk, window: int = 8) -> np.ndarray:
    """Per row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    out = np.zeros((c.rows, 5), np.int64)
    start, end, row = T.spans(c.buf, c.offs, T.SPACED)
    if not len(start):
        return out
    at, hasher = T.per_row(row, c.rows), T.Hasher(c.buf, lower=False)
    out[:, 0] = np.diff(at)
    out[:, 1] = T.sums((T.SPACED[c.buf] & ((c.buf & 0xC0) != 0x80)).astype(np.int64), c.offs)
    out[:, 2] = T.sums(np.isin(c.buf, np.frombuffer(b"#*$%&|<>", np.uint8)).astype(np.int64), c.offs)
    ls, le, lr = T.spans(c.buf, c.offs, T.byte_set(lambda b: b != 0x0A))
    word = np.concatenate([[0], np.cumsum(T.SPACED[c.buf])])
    some = word[le] > word[ls]
    again, _ = _rows(hasher(ls[some], le[some]), lr[some])
    out[:, 3] = np.bincount(lr[some], weights=again, minlength=c.rows)
    h = hasher(start, end)
    m = len(h) - window + 1
    if m > 0:
        g = np.zeros(m, np.uint64)
        for k in range(window):
            g = T.mix(g * np.uint64(0xA24BAED4963EE407) + h[k : k + m])
        first = np.flatnonzero(row[:m] == row[window - 1 :])
        _, twice = _rows(g[first], row[first])
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, first[twice], 1)
        np.add.at(cover, first[twice] + window, -1)
        out[:, 4] = T.sums((np.cumsum(cover[:-1]) > 0).astype(np.int64), at)
    return out


def _sums(docs: DataFrame, part: DataFrame, with_counts: bool) -> DataFrame:
    """Per row: doc_id, lang, a hash of the text, its characters, the base counts (or 0) and the sum of log probabilities of the grams that are in ``part``."""
    rows = part.toArrow()  # about SLICE grams
    lang, logp = np.array(rows.column("lang").to_pylist(), object), rows.column("logp").to_numpy()
    key = _key(np.stack([rows.column(x).to_numpy().astype(np.uint32) for x in _NAMES], 1))
    held = {}
    for x in set(lang.tolist()):
        mine = np.flatnonzero(lang == x)
        mine = mine[np.argsort(key[mine])]
        held[x] = key[mine], logp[mine]
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang = np.array(batch.column("lang").to_pylist(), object)
        counts, sums, size = [np.zeros((0, 5), np.int64)], [], []
        for c in T.chunks(batch.column("text")):
            counts.append(base_counts(c) if with_counts else np.zeros((c.rows, 5), np.int64))
            g, row = grams(c)
            total, here = np.zeros(c.rows), lang[c.lo : c.hi]
            for x in set(here.tolist()) & set(sent.value):
                mine = np.flatnonzero((here == x)[row])
                u, inverse = distinct(g[mine])
                keys, logp = sent.value[x]
                h = _key(u)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                total += np.bincount(row[mine], weights=np.where(keys[at] == h, logp[at], 0.0)[inverse], minlength=c.rows)
            sums.append(total)
            size.append(np.bincount(row, minlength=c.rows))
        n = np.concatenate(counts)
        cols = [batch.column("doc_id"), batch.column("lang"), batch.column("h"), pa.array(np.concatenate(size), pa.int64()), *[pa.array(n[:, k]) for k in range(5)], pa.array(np.concatenate(sums))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "h", "size", *COUNTS, "logp"])

    schema = "doc_id bigint, lang string, h bigint, size bigint, " + ", ".join(f"{k} bigint" for k in COUNTS) + ", logp double"
    return T.by_batch(_read(docs).withColumn("h", F.xxhash64("text")), run, schema)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, model: DataFrame, most: int = SLICE) -> DataFrame:
    """Per row: doc_id, lang, the base counts and log_perplexity (null for empty text); ``model`` is that of ``docs``, read ``most`` grams at a time."""
    passes = max(1, -(-model.count() // most))
    of = F.pmod(F.xxhash64(*_NAMES), F.lit(passes))
    found = reduce(DataFrame.unionByName, [T.stored(_sums(docs, model.filter(of == k), k == 0)) for k in range(passes)])
    if passes > 1:  # equal rows have equal sums
        rows = found.groupBy("doc_id", "lang", "h", "size").agg(F.count("*").alias("rows"), *[(F.max(k)).alias(k) for k in COUNTS], F.sum("logp").alias("logp"))
        copies = (F.col("rows") / passes).cast("int")
        found = rows.withColumn("logp", F.col("logp") / copies).withColumn("_", F.explode(F.sequence(F.lit(1), copies)))
    return found.select("doc_id", "lang", *COUNTS, F.when(F.col("size") > 0, -F.col("logp") / F.col("size")).alias("log_perplexity"))


def rules(docs: DataFrame, width: float = WIDTH, most: int = SLICE) -> DataFrame:
    """Per row: doc_id, the base counts, log_perplexity, its language's band, base_failed and kept."""
    found = T.stored(measure(docs, fit(docs), most))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    q = found.filter("not base_failed").groupBy("lang").agg(F.percentile_approx("log_perplexity", [0.25, 0.75], 2000).alias("q"))
    reach = F.greatest(width * (F.col("q")[1] - F.col("q")[0]), F.lit(LEAST_WIDTH))
    bands = q.select("lang", (F.col("q")[0] - reach).alias("band_low"), (F.col("q")[1] + reach).alias("band_high"))
    # one row for each language
    judged = found.join(F.broadcast(bands), "lang", "left")
    spread = SPREAD / F.sqrt(F.greatest(F.col("word_chars"), F.lit(1)))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("band_low") - spread, F.col("band_high") + spread), F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity", "band_low", "band_high", "base_failed", (~F.col("base_failed") & inside).alias("kept"))
