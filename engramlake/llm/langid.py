"""Language identification of mixed text: scripts, per-word scores, Viterbi with a switching penalty.

``fit`` counts hashed character trigrams (with word bounds) and scripts per language in Spark, over
a bounded sample of labelled rows; the model is one table of 2**16 rows, whatever the corpus.
``label`` gives each word of whole texts a score per language, rules out languages whose training
text does not use the word's script, and finds the best labels of all words of a document under a
penalty for each switch. Blocks of words become max-plus matrices, so Viterbi runs over all
documents of a chunk at once.

Edge cases: null text, and text without a letter, is ``und`` with score 0 and no spans; text in a
script that no language was learned in has equal scores, so the first language by name; ties go to
the first name; rows without a language teach nothing; without any labelled row all is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from engramlake.llm import text as T

#: Bound of the labelled sample that a model is fitted on.
TRAIN_ROWS = 12_000
SWITCH_PENALTY = 12.0
UNKNOWN = "und"
_SLOTS = 1 << 16
_BLOCK = 64

#: First code points of script ranges (Unicode blocks, fixed values): Latin, Greek, Cyrillic, Armenian,
#: Hebrew, Arabic, Indic, Thai, other, Latin Extended, Greek Extended, other, Kana, other, Han, other, Hangul, other.
_SCRIPT_STARTS = np.array([0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0xE80, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0], np.uint32)
_SCRIPTS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 0, 1, 8, 9, 8, 10, 8, 11, 8])
_N_SCRIPTS = 12
#: A language takes part in words of a script if so large a part of its words uses it.
_SCRIPT_SHARE = 0.005


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, and its lower case."""
    letter = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
    return letter, lower


def _words(c: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the letters: trigram slots and each word's first; of the words: row, start, end, script."""
    cps, offs = T.code_points(c)
    letter, lower = _tables()
    member = letter[cps]
    low = np.where(member, lower[cps], 0).astype(np.uint32)
    before, after = np.zeros_like(low), np.zeros_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    if len(low):
        before[offs[:-1][offs[:-1] < len(low)]] = 0
        after[offs[1:][offs[1:] > 0] - 1] = 0
    at = np.flatnonzero(member)
    a, b, d = before[at], low[at], after[at]
    slot = ((a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ d * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)
    first = np.flatnonzero(a == 0)
    start = at[first]
    last = np.append(first[1:], len(at)) - 1
    end = at[last] + 1 if len(first) else at[:0]
    row = np.searchsorted(offs, start, "right") - 1
    script = _SCRIPTS[np.searchsorted(_SCRIPT_STARTS, cps[start], "right") - 1]
    return slot, first, row, start, end, script


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # slots x languages
    allowed: np.ndarray  # scripts x languages


def _evenly(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the rows, drawn by a hash of doc_id; languages with few rows lose none, and the others share what is left evenly."""
    counts = sorted((r["count"], r["lang"]) for r in rows.groupBy("lang").count().collect())  # a row for each language
    left, share = most, {}
    for k, (n, lang) in enumerate(counts):
        share[lang] = min(n, max(1, left // (len(counts) - k)))
        left -= share[lang]
    if all(share[lang] == n for n, lang in counts):
        return rows
    upto = F.create_map(*[F.lit(x) for n, lang in counts for x in (lang, min(2**63 - 1, 2**63 * share[lang] // n))])
    return rows.filter(F.xxhash64(F.lit(11), F.col("doc_id")).bitwiseAND(F.lit(2**63 - 1)) <= upto[F.col("lang")])


def fit(labelled: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """A model from ``labelled`` (doc_id, text, lang), of which at most about ``max_rows`` rows are read: rare languages whole, and as many of each other one."""
    rows = _evenly(labelled.filter("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang")), max_rows)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        totals: dict[str, np.ndarray] = {}
        lang = np.array(batch.column("lang").to_pylist(), object)
        for c in T.chunks(batch.column("text")):
            slot, first, row, _, _, script = _words(c)
            of_letter = np.repeat(row, np.diff(np.append(first, len(slot))))
            here = lang[c.lo : c.hi]
            for x in set(here.tolist()):
                mine = here == x
                t = totals.setdefault(x, np.zeros(_SLOTS + _N_SCRIPTS, np.int64))
                t[:_SLOTS] += np.bincount(slot[mine[of_letter]], minlength=_SLOTS)
                t[_SLOTS:] += np.bincount(script[mine[row]], minlength=_N_SCRIPTS)
        out = [(x, k, int(v[k])) for x, v in totals.items() for k in np.flatnonzero(v)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([int(r[1]) for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int64())], ["lang", "slot", "n"])

    counts = T.by_batch(rows.select("lang", "text"), count, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # at most 2**16 rows for each language
    langs = sorted(found["lang"].unique())
    table = np.zeros((_SLOTS + _N_SCRIPTS, len(langs)))
    table[found["slot"], np.searchsorted(langs, found["lang"])] = found["n"]
    grams, scripts = table[:_SLOTS], table[_SLOTS:]
    p = (grams + 0.5) / (grams.sum(0) + 0.5 * _SLOTS)
    scores = np.log(p) - np.log(p).mean(1, keepdims=True) if langs else p
    allowed = scripts >= np.maximum(1, _SCRIPT_SHARE * scripts.sum(0))
    return Model(langs, scores.astype(np.float32), allowed)


def _word_scores(m: Model, slot: np.ndarray, first: np.ndarray, script: np.ndarray) -> np.ndarray:
    s = np.add.reduceat(m.scores[slot], first, axis=0)
    ok = m.allowed[script]
    ok |= ~ok.any(1, keepdims=True)
    return np.where(ok, s, s.min(1, keepdims=True) - 1000)


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word, for the words of each row between successive bounds."""
    n, k = scores.shape
    words = np.diff(bounds)
    blocks = -(-words // _BLOCK)
    of = np.concatenate([[0], np.cumsum(blocks)])  # first block of each row
    nb = int(of[-1])
    row = np.repeat(np.arange(len(words)), blocks)
    start = bounds[row] + (np.arange(nb) - of[row]) * _BLOCK
    place = start[:, None] + np.arange(_BLOCK)
    w = np.concatenate([scores, np.zeros((1, k), scores.dtype)])[np.where(place < bounds[row + 1][:, None], place, n)]
    # each block as a matrix from the label before it to the label of its last word
    a = np.where(np.eye(k, dtype=bool), 0.0, -1e9).astype(np.float32)[None].repeat(nb, 0)
    for t in range(_BLOCK):
        a = w[:, t, None, :] + np.maximum(a, a.max(-1, keepdims=True) - penalty)
    order = np.argsort(-blocks, kind="stable")
    entry = np.zeros((nb, k), np.float32)
    v = np.zeros((len(words), k), np.float32)
    live = [int((blocks[order] > j).sum()) for j in range(int(blocks.max(initial=0)))]
    for j, m in enumerate(live):
        b = of[order[:m]] + j
        entry[b] = v[:m]
        v[:m] = (v[:m, :, None] + a[b]).max(1)
        v[:m] -= v[:m].max(1, keepdims=True)
    # forward again inside the blocks, now with what comes before; stay[t]: keeps the label
    number = np.int8 if k <= 127 else np.int32  # what holds a label
    v, jump, stay = entry, np.empty((_BLOCK, nb), number), np.empty((_BLOCK, nb, k), bool)
    for t in range(_BLOCK):
        jump[t] = v.argmax(1)
        top = v.max(1, keepdims=True) - penalty
        stay[t] = v >= top
        v = w[:, t] + np.maximum(v, top)
    label = np.repeat(np.arange(k, dtype=number)[None], nb, 0)  # by the label of the block's last word
    path = np.empty((_BLOCK, nb, k), number)
    for t in range(_BLOCK - 1, -1, -1):
        path[t] = label
        label = np.where(np.take_along_axis(stay[t], label.astype(np.int64), 1), label, jump[t][:, None])
    # backward over the blocks of each row
    leave = np.zeros(nb, np.int64)
    last = (of[1:] - 1)[order]
    some = blocks[order] > 0
    state = np.zeros(len(words), np.int64)
    state[some] = v[last[some]].argmax(1)
    for j in range(len(live) - 1, -1, -1):
        b = of[order[: live[j]]] + j
        leave[b] = state[: live[j]]
        state[: live[j]] = label[b, leave[b]]
    chosen = np.take_along_axis(path, leave[None, :, None], 2)[:, :, 0].T
    return chosen[place < bounds[row + 1][:, None]]


def _label_batch(texts: pa.Array, m: Model, penalty: float, with_spans: bool = True) -> tuple[list[str], list[float], list[list[dict]]]:
    pred: list[str] = []
    score: list[float] = []
    spans: list[list[dict]] = []
    for c in T.chunks(texts):
        slot, first, row, start, end, script = _words(c)
        if not len(first) or not m.langs:
            pred += [UNKNOWN] * c.rows
            score += [0.0] * c.rows
            spans += [[] for _ in range(c.rows)]
            continue
        at = T.per_row(row, c.rows)
        tags = viterbi(_word_scores(m, slot, first, script), at, penalty).astype(np.int64)
        k = len(m.langs)
        letters = np.diff(np.append(first, len(slot)))
        share = np.bincount(row * k + tags, weights=letters, minlength=c.rows * k).reshape(c.rows, k)
        total, best = share.sum(1), share.argmax(1)
        pred += [m.langs[best[r]] if total[r] else UNKNOWN for r in range(c.rows)]
        score += (share[np.arange(c.rows), best] / np.maximum(total, 1)).tolist()
        if with_spans:
            new = np.ones(len(tags), bool)
            new[1:] = (tags[1:] != tags[:-1]) | (row[1:] != row[:-1])
            begin = np.flatnonzero(new)
            stop = np.append(begin[1:], len(tags)) - 1
            base = T.code_points(c)[1][row[begin]]
            runs = [{"start": a, "end": b, "lang": m.langs[x]} for a, b, x in zip((start[begin] - base).tolist(), (end[stop] - base).tolist(), tags[begin].tolist(), strict=True)]
            of = T.per_row(row[begin], c.rows)
            spans += [runs[of[r] : of[r + 1]] for r in range(c.rows)]
    return pred, score, spans


def label(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Per row: doc_id, lang_pred, score (its share of the letters) and spans (code point ranges with a language)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**16 numbers a language
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pred, score, spans = _label_batch(batch.column("text"), sent.value, penalty)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return T.by_batch(read, run, "doc_id bigint, lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>")


def with_language(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with all its columns, and the language and its share of the letters under ``names``, which must be free."""
    if set(names) & set(docs.columns):
        raise ValueError(f"the table has a column {names[0]} or {names[1]}; choose other names")
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = _label_batch(batch.column(at), sent.value, penalty, with_spans=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())], [*batch.schema.names, *names])

    schema = StructType(list(docs.schema.fields)).add(names[0], "string").add(names[1], "double")
    return T.small_batches(docs).mapInArrow(run, schema)


def in_known_language(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The rows with a language, with it as their ``lang``; all other columns stay, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        for batch in batches:
            pred = _label_batch(batch.column(text), sent.value, penalty, with_spans=False)[0]
            cols = list(batch.columns)
            cols[lang] = pa.array(pred, batch.schema.field(lang).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema).filter(pa.array([x != UNKNOWN for x in pred], pa.bool_()))

    return T.small_batches(docs).mapInArrow(run, docs.schema)
