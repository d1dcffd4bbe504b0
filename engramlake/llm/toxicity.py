"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers read the words of a clause: insults, threats, targets, negations and reported speech. All but
the first are small machines as arrays of arcs (``countdown``: how far a word still reaches; ``latch``: whether
one came before), composed into one machine that reads from the left and one that reads from the right. The
states of both at a word decide in which way it matches: an insult is plain, aimed at someone, beside a threat,
negated or reported, and a threat with a target in reach is a match of its own (a menace), with or without an
insult. Insult words, and word beginnings, are learned from labelled toxic texts, with their log odds as weights
of the arcs. A logistic model over the clause sums of each way makes the score, so what a negated or reported
insult weighs is learned and not assumed.

Edge cases: null and empty texts have no clause and get the score of a text without a match; very long texts are
read whole, in time that is linear in their words; null labels teach nothing; without positive labels the lexicon
is empty and only threats at targets match; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm import text as T

#: Bound of the labelled sample that a model is fitted on.
TRAIN_ROWS = 20_000
#: Bytes of the word beginnings that the lexicon may hold beside whole words.
BEGINNINGS = (4, 5, 6, 7)
#: Least number of toxic texts that an entry of the lexicon occurs in.
LEAST_TEXTS = 4

#: Fixed word lists of the grammar, for English, German, French and Spanish.
THREATS = "kill hurt destroy beat shoot punch stab töte schlage vernichte tuer frapper détruire matar golpear destruir"
TARGETS = "you your yours he him she her they them their du dich dir dein sie ihr euch tu toi vous il elle ils usted tú él ella ellos"
NEGATIONS = "not no never neither nor without isn't aren't don't nicht kein keine nie ohne ne pas jamais sans no nunca jamás sin"
REPORTS = "said says say wrote called claimed quoted reported sagte schrieb nannte meinte dit écrit appelé dijo escribió llamó"
_CLASSES = {1: THREATS, 2: TARGETS, 3: NEGATIONS, 4: REPORTS}
_SYMBOLS = 5  # any other word, and the four classes
_REACH = 3  # words that a negation, target or threat reaches

#: A menace is a threat at a target; ``menace_off`` is one that is negated or reported.
WAYS = ("plain", "aimed", "negated", "reported", "threat", "menace", "menace_off", "largest", "hits")
_CLAUSE_ENDS = T.byte_set(lambda b: chr(b) in ".!?;:,\n|()\"")


@dataclass
class Lexicon:
    hashes: np.ndarray  # sorted
    weights: np.ndarray


@dataclass
class Model:
    lexicon: Lexicon
    beta: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def _word_hashes(c: T.Chunk) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Start and row of each word, and (words, hashes) of whole words and of their beginnings."""
    start, end, row = T.spans(c.buf, c.offs, T.LETTERS)
    if not len(start):
        return start, row, []
    hasher = T.Hasher(c.buf)
    kinds = [(np.arange(len(start)), hasher(start, end))]
    for k in BEGINNINGS:
        some = np.flatnonzero(end - start > k)
        kinds.append((some, T.mix(hasher(start[some], start[some] + k) ^ np.uint64(k))))
    return start, row, kinds


def _lookup(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``h`` are in the sorted ``table``, and where; a bitmap settles most."""
    if not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    maybe = np.zeros(1 << 16, bool)
    maybe[(table & np.uint64(0xFFFF)).astype(np.int64)] = True
    some = np.flatnonzero(maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
    k = np.minimum(np.searchsorted(table, h[some]), len(table) - 1)
    ok = table[k] == h[some]
    return some[ok], k[ok]


def _class_table() -> tuple[np.ndarray, np.ndarray]:
    h, cls = [], []
    for k, words in _CLASSES.items():
        for w in dict.fromkeys(words.split()):
            b = np.frombuffer(w.encode(), np.uint8)
            h.append(T.Hasher(b)(np.array([0]), np.array([len(b)]))[0])
            cls.append(k)
    order = np.argsort(np.array(h, np.uint64), kind="stable")
    return np.array(h, np.uint64)[order], np.array(cls)[order]


# --- the machines --------------------------------------------------------------------------------


@dataclass
class Machine:
    """Arcs as an array, state x symbol to state; it begins in state 0. ``parts``: the number of states of each machine in it."""

    arcs: np.ndarray
    parts: tuple[int, ...]

    def of(self, k: int) -> np.ndarray:
        """The state of part ``k`` in each state."""
        below = int(np.prod(self.parts[k + 1 :], dtype=np.int64))
        return np.arange(len(self.arcs)) // below % self.parts[k]


def countdown(symbol: int, reach: int = _REACH) -> Machine:
    """In state k, a word of the class came, and reaches k more words."""
    arcs = np.repeat(np.maximum(np.arange(reach + 1) - 1, 0)[:, None], _SYMBOLS, 1)
    arcs[:, symbol] = reach
    return Machine(arcs, (reach + 1,))


def latch(symbol: int) -> Machine:
    """In state 1, a word of the class came before, in this clause."""
    arcs = np.repeat(np.arange(2)[:, None], _SYMBOLS, 1)
    arcs[:, symbol] = 1
    return Machine(arcs, (2,))


def compose(*machines: Machine) -> Machine:
    """All machines on the same words at once."""
    out = machines[0]
    for m in machines[1:]:
        arcs = out.arcs[:, None, :] * len(m.arcs) + m.arcs[None, :, :]
        out = Machine(arcs.reshape(-1, _SYMBOLS), (*out.parts, *m.parts))
    return out


THREAT, TARGET, NEGATION, REPORT = countdown(1), countdown(2), countdown(3), latch(4)
FROM_LEFT, FROM_RIGHT = compose(THREAT, TARGET, NEGATION, REPORT), compose(THREAT, TARGET)


@lru_cache(1)
def grammar() -> tuple[list, list, list, list, list, list]:
    """As lists, for walking: arcs from the left and from the right, both over runs of up to _REACH + 1 other words, and for
    each pair of states the way in which an insult, and a threat, matches (-1: not at all)."""

    def runs(m: Machine) -> list:
        at = [np.arange(len(m.arcs))]
        for _ in range(_REACH + 1):
            at.append(m.arcs[at[-1], 0])
        return [a.tolist() for a in at]

    left, right = FROM_LEFT, FROM_RIGHT
    both = lambda k: (left.of(k)[:, None] > 0) | (right.of(k)[None, :] > 0)
    alone = lambda k: np.repeat(left.of(k)[:, None] > 0, len(right.arcs), 1)
    way = {k: i for i, k in enumerate(WAYS)}
    insult = np.select([alone(3), alone(2), both(0), both(1)], [way["reported"], way["negated"], way["threat"], way["aimed"]], way["plain"])
    threat = np.where(both(1), np.where(alone(3) | alone(2), way["menace_off"], way["menace"]), -1)
    return left.arcs.tolist(), right.arcs.tolist(), runs(left), runs(right), insult.tolist(), threat.tolist()


def walk(places: list[int], symbols: list[int], weights: list[float], first: int, last: int) -> list[tuple[int, float]]:
    """(way, weight) of each match in the clause from word ``first`` to ``last``; only its words with a class or a weight are given."""
    by_left, by_right, left_runs, right_runs, insult, threat = grammar()
    states, s, at = [], 0, first
    for p, a in zip(places, symbols, strict=True):
        s = left_runs[min(p - at, _REACH + 1)][s]
        states.append(s)
        s, at = by_left[s][a], p + 1
    out, s, at = [], 0, last
    for i in range(len(places) - 1, -1, -1):
        s = right_runs[min(at - places[i], _REACH + 1)][s]
        if weights[i] > 0:
            w = insult[states[i]][s]
            out.append((WAYS.index("threat") if symbols[i] == 1 and w == 0 else w, weights[i]))
        if symbols[i] == 1 and threat[states[i]][s] >= 0:
            out.append((threat[states[i]][s], 1.0))
        s, at = by_right[s][symbols[i]], places[i] - 1
    return out


def clause_sums(c: T.Chunk, lexicon: Lexicon) -> np.ndarray:
    """A row of WAYS for each text of a chunk."""
    out = np.zeros((c.rows, len(WAYS)))
    start, row, kinds = _word_hashes(c)
    if not len(start):
        return out
    weight = np.zeros(len(start))
    for words, h in kinds:
        hit, k = _lookup(lexicon.hashes, h)
        np.maximum.at(weight, words[hit], lexicon.weights[k])
    table, classes = _class_table()
    cls = np.zeros(len(start), np.int64)
    hit, k = _lookup(table, kinds[0][1])
    cls[hit] = classes[k]
    ends = np.concatenate([[0], np.cumsum(_CLAUSE_ENDS[c.buf])])
    clause = ends[start] + row  # a new row begins a new clause
    wanted = np.unique(clause[(weight > 0) | (cls == 1)])
    told = np.flatnonzero((weight > 0) | (cls > 0))
    first, last = np.searchsorted(clause, wanted), np.searchsorted(clause, wanted, "right")
    lo, hi = np.searchsorted(told, first), np.searchsorted(told, last)
    menaces = {WAYS.index("menace"), WAYS.index("menace_off")}
    for a, b, x, y in zip(first.tolist(), last.tolist(), lo.tolist(), hi.tolist(), strict=True):
        at = told[x:y]
        r, total = row[a], 0.0
        for way, w in walk(at.tolist(), cls[at].tolist(), weight[at].tolist(), a, b - 1):
            out[r, way] += w
            if way not in menaces:
                total += w
                out[r, -1] += 1
        out[r, -2] = max(out[r, -2], total)
    return np.log1p(out)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _texts_with(rows: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """(h, n): in how many texts each word or beginning occurs; only wanted ones, if given."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = []
        for c in T.chunks(batch.column("text")):
            _, row, kinds = _word_hashes(c)
            for words, h in kinds:
                r = row[words]
                if wanted is not None:
                    hit, _ = _lookup(wanted, h)
                    h, r = h[hit], r[hit]
                order = np.lexsort((h, r))
                h, r = h[order], r[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                seen.append(h[new])
        h, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    return T.by_batch(rows.select("text"), run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """A model from the 0/1 column ``toxic`` of ``labels`` (doc_id), of which at most about ``max_rows`` rows are read."""
    labels = labels.filter("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    some = T.stored(T.bounded(labels, max_rows, "doc_id"))
    rows = T.stored(T.with_ids(_read(docs), some, "left_semi").join(some, "doc_id"))
    size = dict(rows.groupBy("y").count().collect())
    pos, neg = size.get(1, 0), size.get(0, 0)
    lexicon = Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    if pos:
        # the sample's size bounds how many entries can be so frequent, whatever the input's size
        often = _texts_with(rows.filter("y = 1"), None).filter(F.col("n") >= LEAST_TEXTS).toPandas().astype({"h": "int64"})
        h = often["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, in_pos = h[order], often["n"].to_numpy(float)[order]
        others = _texts_with(rows.filter("y = 0"), h).toPandas().astype({"h": "int64"})
        in_neg = pd.Series(others["n"].to_numpy(float), others["h"].to_numpy().view(np.uint64)).reindex(h).fillna(0).to_numpy()
        weight = np.log((in_pos + 0.5) / (pos + 1)) - np.log((in_neg + 0.5) / (neg + 1))
        sure = weight - 2 * np.sqrt(1 / (in_pos + 0.5) + 1 / (in_neg + 0.5)) > 1
        lexicon = Lexicon(h[sure], weight[sure])
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.concatenate([clause_sums(c, sent.value) for c in T.chunks(batch.column("text"))])
        lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(WAYS), dtype=np.int32), x.ravel())
        return pa.RecordBatch.from_arrays([lists, batch.column("y"), batch.column("doc_id")], ["x", "y", "doc_id"])

    got = T.by_batch(rows.select("text", "y", "doc_id"), run, "x array<double>, y int, doc_id bigint").toPandas().sort_values("doc_id", kind="stable")
    x, y = np.array(got["x"].tolist()).reshape(len(got), len(WAYS)), got["y"].to_numpy(float)
    return _menaces(Model(lexicon, *_logistic(x, y)), x)


def _menaces(m: Model, x: np.ndarray) -> Model:
    """Where no menace occurs in the sample ``x``, one counts as a plain insult of median weight does."""
    plain, menace, largest, hits = (WAYS.index(k) for k in ("plain", "menace", "largest", "hits"))
    if len(m.lexicon.weights) and not x[:, menace].any():
        each = m.beta[1:] / m.scale
        m.mean[menace], m.scale[menace] = 0.0, 1.0
        m.beta[1 + menace] = max(0.0, np.log1p(np.median(m.lexicon.weights)) / np.log(2) * (each[plain] + each[largest]) + each[hits])
    return m


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps for a logistic model on standardized columns."""
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    scale = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(x.shape[1])
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    beta = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], l2)
    ridge[0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-z @ beta))
        grad = z.T @ (y - p) - ridge * beta
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), grad)
        beta += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
    return beta, mean, scale


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (probability of label 1) and the clause sums behind it."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a lexicon of bounded size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        x = np.concatenate([clause_sums(c, m.lexicon) for c in T.chunks(batch.column("text"))])
        p = 1 / (1 + np.exp(-(m.beta[0] + ((x - m.mean) / m.scale) @ m.beta[1:])))
        lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(WAYS), dtype=np.int32), x.ravel())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), lists], ["doc_id", "score", "ways"])

    return T.by_batch(_read(docs), run, "doc_id bigint, score double, ways array<double>")
