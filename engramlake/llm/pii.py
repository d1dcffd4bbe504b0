"""Personal data: exact patterns, and a linear-chain conditional random field beside them.

The base patterns (email, ip, card, phone) are matched leftmost and without overlaps, in time that
is linear in the text. The field labels the words around each word that holds a digit or an ``@``:
features of word shapes and of neighbours, weights trained on a small labelled table that rules
write, Viterbi in numpy over all windows of a batch. It adds spans that no base span overlaps:
forms of the same kinds that the patterns miss, identity numbers and secrets. Words without a digit
or ``@`` are never part of an added span, which makes the windows exact.

Edge cases: null counts as empty; empty texts have no spans and the digest of an empty list; rows
are judged one by one, so repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm import text as T

BASE = ("email", "ip", "card", "phone")
#: Kinds in the order that breaks ties of equal starts; the field adds the last two.
KINDS = (*BASE, "id", "secret")

# The base patterns are fixed values; the code below finds their matches without quadratic search.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\s]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All base spans, by start and then by kind."""
    found: list[Span] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > floor and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at) if lo < at else None
        if m:
            found.append(("email", lo, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", max(at + 1, floor))
    if _TRIGGER.search(text):
        for m in _DOTTED.finditer(text):
            parts, start = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = start + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                    found.append(("ip", start, end))
                start = end + 1
        for m in _CARD.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- the field ---------------------------------------------------------------------------------

_ADDED = ("email", "card", "phone", "id", "secret")
LABELS = ("O", *(f"{p}-{k}" for k in _ADDED for p in "BI"))
_WIDTH = 1 << 12
_AROUND = 3  # words of a window beside each word with a digit or @


def shape(word: str) -> str:
    """Letters as x or X, digits as 9, runs of more than three cut to three."""
    s = re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", re.sub(r"[0-9]", "9", word[:80]))
    return re.sub(r"(.)\1{3,}", r"\1\1\1", s)


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=4).digest(), "little") % _WIDTH


@lru_cache(20_000)
def _own(word: str) -> tuple[int, ...]:
    """Features of a word by itself."""
    digits = sum(c.isdigit() for c in word)
    core = word.strip(".,;:()[]\"'")
    hexed = len(core) >= 20 and not set(core.lower()) - set("0123456789abcdef")
    f = [f"s={shape(core)}", f"n={min(len(core), 24) // 2}", f"d={min(digits, 20)}", f"r={digits * 4 // max(1, len(core))}", f"hex={hexed}", f"mix={bool(re.search('[a-z]', core)) and bool(re.search('[A-Z]', core)) and digits > 2}"]
    f += [f"luhn={14 <= digits <= 19 and core.isdecimal() and core.isascii() and luhn(core)}", f"plus={core[:1] == '+'}", f"set={'=' in core and digits > 0}"]
    f += ["any"] + ([f"w={core.lower()}"] if not digits and len(core) < 16 else [])
    return tuple(_hash(x) for x in f)


@lru_cache(20_000)
def _beside(word: str, where: int) -> tuple[int, ...]:
    core = word.strip(".,;:()[]\"'=").lower()
    f = [f"{where}s={shape(core)}"] + ([f"{where}w={core}"] if len(core) < 16 and not re.search("[0-9]", core) else [])
    return tuple(_hash(x) for x in f)


def word_features(words: list[str]) -> list[list[int]]:
    pad = ["<", "<", *words, ">"]
    return [[*_own(w), *_beside(pad[i + 1], -1), *_beside(pad[i], -2), *_beside(pad[i + 3], 1)] for i, w in enumerate(words)]


def can_be_part(word: str) -> bool:
    return bool(_TRIGGER.search(word))


@lru_cache(1)
def training_table() -> list[tuple[list[str], list[str]]]:
    """The small labelled table: sentences that rules write, with a label for each word."""
    rng = np.random.default_rng(5)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(of[i] for i in rng.integers(0, len(of), n))
    before = ["call me at", "phone", "tel", "my number is", "mobile", "fax", "reach us on", "telefon", "téléphone", "teléfono"]
    id_cues = ["ssn", "social security number", "passport", "iban", "tax id", "ausweis", "dni"]
    key_cues = ["token =", "api_key =", "password :", "secret =", "key :", "auth token"]
    filler = [letters(int(rng.integers(2, 10))) for _ in range(60)]
    some = lambda n: list(rng.choice(filler, n))
    table = []

    def put(cue: str, value: list[str], kind: str | None) -> None:
        a, b = some(int(rng.integers(0, 4))), some(int(rng.integers(1, 4)))
        c = cue.split()
        tags = ["O"] * len(value) if kind is None else [f"{'I' if i else 'B'}-{kind}" for i in range(len(value))]
        table.append((a + c + value + b, ["O"] * (len(a) + len(c)) + tags + ["O"] * len(b)))

    def card() -> str:
        head = "4" + digits(14)
        return next(head + str(d) for d in range(10) if luhn(head + str(d)))

    for _ in range(9):
        for cue in ("", "and", "at"):
            phone = [f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"]
            both = [(phone, "phone"), ([card()], "card")]
            both = both if rng.integers(2) else both[::-1]
            a = some(2)
            table.append((a + cue.split() + [w for v, _ in both for w in v] + a, ["O"] * (2 + len(cue.split())) + [f"{'I' if i else 'B'}-{k}" for v, k in both for i in range(len(v))] + ["O", "O"]))
        put("card", [card()], "card")
        put("", [f"password={letters(18, '0123456789abcdef')}"], "secret")
        put("", [f"{['token', 'key', 'secret', 'pwd'][rng.integers(4)]}={letters(24, '0123456789abcdef')}"], "secret")
        for cue in before:
            put(cue, [[f"0{digits(3)}-{digits(7)}"], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"0{digits(2)}", digits(4), digits(4)], [f"{digits(3)}-{digits(3)}-{digits(4)}"]][rng.integers(4)], "phone")
        for cue in id_cues:
            put(cue, [[f"{digits(3)}-{digits(2)}-{digits(4)}"], [letters(2, "ABCDEFGHIJKLMNPRSTUVXYZ") + digits(20)], [letters(1, "ABCDEFGH") + digits(8)]][rng.integers(3)], "id")
        for cue in key_cues:
            put(cue, [[f'"{letters(40, "0123456789abcdef")}"'], [letters(3, "skp") + "_" + letters(24, "abcdefghijkmnpqrstuvABCDEFGHJKLMN0123456789")], [letters(32, "0123456789abcdef")]][rng.integers(3)], "secret")
        put("mail", [f"{letters(5)}@{letters(6)}"], "email")
        put("write to", [f"{letters(5)}.{letters(4)}@{letters(6)}"], "email")
        for cue in ("in", "since", "year", "on page", "chapter", "costs", "about", "version", "order", "item", ""):
            put(cue, [[digits(4)], [digits(2)], [digits(1)], [f"{digits(1)}.{digits(2)}"], [f"{digits(2)}%"], [f"{digits(1)},{digits(3)}"], [digits(16)], [f"{letters(4)}{digits(2)}"], [digits(8)], [f"{digits(4)}-{digits(2)}-{digits(2)}"], [digits(6)]][rng.integers(11)], None)
        for _ in range(4):
            put(some(1)[0], [f"@{letters(6)}"], None)
            put(some(1)[0], [letters(4) + digits(2) + letters(3)], None)
    return table


_MASK = np.array([[0.0] + [-1e6] * (len(LABELS) - 1), [0.0] * len(LABELS)])


@lru_cache(1)
def _links() -> np.ndarray:
    """I-x only follows B-x or I-x."""
    out = np.zeros((len(LABELS) + 1, len(LABELS)))  # the last row: from the start
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i in range(len(LABELS) + 1):
                if i == len(LABELS) or LABELS[i][1:] != b[1:]:
                    out[i, j] = -1e6
    return out


@lru_cache(1)
def train(rounds: int = 80, rate: float = 0.3, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights, by gradient ascent on the conditional likelihood of the table.

    All sentences go side by side: forward and backward sums step over word places.
    """
    table = training_table()
    k, n, longest = len(LABELS), len(table), max(len(w) for w, _ in table)
    feats = [word_features(w) for w, _ in table]
    per = max(len(f) for s in feats for f in s)
    x = np.full((n, longest, per), _WIDTH)
    gold, live, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool), np.zeros((n, longest, k))
    for i, (words, tags) in enumerate(table):
        for t, f in enumerate(feats[i]):
            x[i, t, : len(f)] = f
            gold[i, t], live[i, t] = LABELS.index(tags[t]), True
            mask[i, t] = _MASK[int(can_be_part(words[t]))]
    e, tr = np.zeros((_WIDTH + 1, k)), np.zeros((k + 1, k))
    ge2, gt2 = np.full_like(e, 1e-3), np.full_like(tr, 1e-3)
    lse = lambda v, a: (m := v.max(a, keepdims=True)).squeeze(a) + np.log(np.exp(v - m).sum(a))
    rows = np.arange(n)
    for _ in range(rounds):
        s, trans = e[x].sum(2) + mask, tr + _links()
        f, b = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        f[:, 0] = s[:, 0] + trans[k]
        for t in range(1, longest):
            f[:, t] = np.where(live[:, t, None], lse(f[:, t - 1, :, None] + trans[:k], 1) + s[:, t], f[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(live[:, t + 1, None], lse(trans[:k] + (s[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        z = lse(f[:, -1], 1)
        p = np.exp(f + b - z[:, None, None]) * live[:, :, None]
        diff = -p
        diff[rows[:, None], np.arange(longest), gold] += live
        ge = np.zeros_like(e)
        np.add.at(ge, x.ravel(), np.repeat(diff.reshape(-1, k), per, 0))
        ge[_WIDTH] = 0
        gt = np.zeros_like(tr)
        gt[k] -= p[:, 0].sum(0)
        np.add.at(gt, (np.full(n, k), gold[:, 0]), 1)
        for t in range(1, longest):
            both = np.exp(f[:, t - 1, :, None] + trans[:k] + (s[:, t] + b[:, t])[:, None, :] - z[:, None, None]) * live[:, t, None, None]
            gt[:k] -= both.sum(0)
            np.add.at(gt, (gold[live[:, t], t - 1], gold[live[:, t], t]), 1)
        ge, gt = ge - l2 * e, gt - l2 * tr
        ge2 += ge**2
        gt2 += gt**2
        e += rate * ge / np.sqrt(ge2)
        tr += rate * gt / np.sqrt(gt2)
    return e, tr


def decode(windows: list[list[str]], weights: tuple[np.ndarray, np.ndarray]) -> list[list[str]]:
    """Labels of the words of each window: Viterbi, all windows that are long enough at each step."""
    if not windows:
        return []
    e, tr = weights
    k, trans = len(LABELS), tr + _links()
    order = sorted(range(len(windows)), key=lambda i: -len(windows[i]))
    size = np.array([len(windows[i]) for i in order])
    flat = [f for i in order for f in word_features(windows[i])]
    which = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
    s = np.zeros((len(flat), k))
    np.add.at(s, which, e[np.concatenate([np.array(f) for f in flat])])
    s += _MASK[[int(can_be_part(w)) for i in order for w in windows[i]]]
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    v = s[first] + trans[k]
    back = np.zeros((len(flat), k), np.int8)
    steps = int(size[0])
    live = [int((size > t).sum()) for t in range(steps)]
    for t in range(1, steps):
        m = live[t]
        c = v[:m, :, None] + trans[:k]
        back[first[:m] + t] = c.argmax(1)
        v[:m] = c.max(1) + s[first[:m] + t]
    state, out = v.argmax(1), np.zeros(len(flat), int)
    for t in range(steps - 1, -1, -1):
        m = live[t]
        out[first[:m] + t] = state[:m]
        state[:m] = back[first[:m] + t, state[:m]]
    tags: list[list[str]] = [[] for _ in windows]
    for i, a, n in zip(order, first, size, strict=True):
        tags[i] = [LABELS[j] for j in out[a : a + n]]
    return tags


def _windows(text: str) -> list[list[tuple[str, int]]]:
    """Runs of words within reach of a word with a digit or @, with their places."""
    near: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        if near and m.start() < near[-1][1]:
            continue
        lo = hi = m.start()
        for _ in range(_AROUND + 1):  # word by word to the left, then to the right
            while lo > 0 and text[lo - 1].isspace():
                lo -= 1
            while lo > 0 and not text[lo - 1].isspace():
                lo -= 1
        for _ in range(_AROUND + 1):
            while hi < len(text) and text[hi].isspace():
                hi += 1
            while hi < len(text) and not text[hi].isspace():
                hi += 1
        if near and lo <= near[-1][1]:
            near[-1] = (near[-1][0], hi)
        else:
            near.append((lo, hi))
    return [w for lo, hi in near if (w := [(m[0], m.start()) for m in _WORD.finditer(text, lo, hi)])]


def plausible(kind: str, value: str) -> bool:
    """What a kind's value must be, whatever the field says."""
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not re.search(r"[^\W\d_]", value)
    return kind != "email" or "@" in value


def added_spans(texts: list[str], base: list[list[Span]], weights: tuple[np.ndarray, np.ndarray]) -> list[list[Span]]:
    """The field's spans of each text that overlap no base span."""
    found = [(i, w) for i, t in enumerate(texts) for w in _windows(t)]
    out: list[list[Span]] = [[] for _ in texts]
    for (i, words), tags in zip(found, decode([[w for w, _ in x] for _, x in found], weights), strict=True):
        run: Span | None = None
        runs: list[Span] = []
        for (word, at), tag in zip([*words, ("", 0)], [*tags, "O"], strict=True):
            if tag[0] != "I" and run:
                runs.append(run)
                run = None
            if tag[0] == "B":
                a = len(word) - len(word.lstrip("\"'([{<"))
                run = (tag[2:], at + a, at + max(a + 1, len(word.rstrip(".,;:!?\"')]}>"))))
            elif tag[0] == "I" and run:
                run = (run[0], run[1], at + max(1, len(word.rstrip(".,;:!?\"')]}>"))))
        for kind, lo, hi in runs:
            if plausible(kind, texts[i][lo:hi]) and not any(lo < e and s < hi for _, s, e in base[i]):
                out[i].append((kind, lo, hi))
    return out


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base and added spans as arrays of (kind, start, end) in code points."""
    sent = docs.sparkSession.sparkContext.broadcast(train())  # weights of a fixed size
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, added = [], []
        for texts in T.slices(batch):
            some = [i for i, t in enumerate(texts) if t and _TRIGGER.search(t)]
            mine, more = [[] for _ in texts], [[] for _ in texts]
            for i in some:
                mine[i] = base_spans(texts[i])
            for i, x in zip(some, added_spans([texts[i] for i in some], [mine[i] for i in some], sent.value), strict=True):
                more[i] = x
            base += mine
            added += more
        cols = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in v], kind) for v in (base, added)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "base", "added"])

    span = "array<struct<kind: string, start: int, end: int>>"
    return T.by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, f"doc_id bigint, base {span}, added {span}")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    rank = lambda k: F.array_position(F.array(*[F.lit(x) for x in KINDS]), k)
    both = F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.concat_ws(",", F.transform("base", said)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform(F.array_sort(both), said)).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets and n_chars set anew; other columns stay.

    Overlapping spans are replaced together, by the kind of the first.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train())
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for texts in T.slices(batch, at):
            some = [i for i, t in enumerate(texts) if t and _TRIGGER.search(t)]
            base = [base_spans(texts[i]) for i in some]
            for i, b, more in zip(some, base, added_spans([texts[i] for i in some], base, sent.value), strict=True):
                t, out, done = texts[i], [], 0
                for kind, lo, hi in in_order(b + more):
                    if lo >= done:
                        out += [t[done:lo], f"[{kind.upper()}]"]
                    done = max(done, hi)
                texts[i] = "".join([*out, t[done:]])
            parts.append(pa.array(texts, batch.schema.field(at).type))
        cols = list(batch.columns)
        cols[at] = pa.concat_arrays(parts) if parts else cols[at]
        return pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    done = T.small_batches(docs).mapInArrow(lambda batches: (run(b) for b in batches), docs.schema)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done
