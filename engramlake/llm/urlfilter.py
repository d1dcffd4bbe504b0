"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest.

Hosts, paths and rules are DataFrame expressions. The trees see length, depth, digit share, entropy,
parameters, host form and statistics of the host's suffix. They are fitted on a labelled table of URLs
(``fit_table``, of which a bounded sample is read), or, where none is given, on a small one that rules
write (``fit``), and sent as flat arrays. The written table knows addresses instead of names, stuffed hosts,
many parameters and deep random paths as spam; on tables without such URLs it blocks next to nothing.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged
by its features, as is an empty text; rows are judged one by one, so repeated rows get equal results.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.llm import gbt
from engramlake.llm import text as T

FEATURES = ("length", "host_length", "host_dots", "host_hyphens", "host_digits", "depth", "digits", "entropy", "parameters", "escapes", "odd", "longest_word", "numeric_host", "suffix")
#: Least probability of class 1 (block) that blocks.
BLOCK = 0.5

Rule = tuple[str, str]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.

    ``rules``: (verdict, host and path), tried from the longest on.
    """
    which = verdict = F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        which, verdict = F.when(fits, rule).otherwise(which), F.when(fits, what).otherwise(verdict)
    return which, verdict


@dataclass
class Model:
    forest: gbt.Forest
    suffixes: dict[str, float]


def lexical(urls: list[str], hosts: list[str], suffixes: dict[str, float]) -> np.ndarray:
    """A row of FEATURES for each URL."""
    n = len(urls)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    (c,), (h,) = (list(T.chunks(pa.array(x, pa.string()), 1 << 60)) for x in (urls, hosts))
    count = np.bincount(np.repeat(np.arange(n), np.diff(c.offs)) * 256 + c.buf, minlength=n * 256).reshape(n, 256).astype(float)
    of_host = np.bincount(np.repeat(np.arange(n), np.diff(h.offs)) * 256 + h.buf, minlength=n * 256).reshape(n, 256)
    size, host_size = np.maximum(np.diff(c.offs), 1), np.maximum(np.diff(h.offs), 1)
    digit = slice(ord("0"), ord("9") + 1)
    p = count / size[:, None]
    start, end, row = T.spans(c.buf, c.offs, T.ALNUM)
    longest = np.zeros(n)
    np.maximum.at(longest, row, end - start)
    host_digits = of_host[:, digit].sum(1)
    columns = (
        size, host_size, of_host[:, ord(".")], of_host[:, ord("-")], host_digits / host_size, count[:, ord("/")], count[:, digit].sum(1) / size,
        -(p * np.log(np.maximum(p, 1e-12))).sum(1), count[:, ord("&")] + count[:, ord("?")], count[:, ord("%")],
        count[:, [ord(x) for x in "@!$*~^{}|'"]].sum(1) + count[:, 128:].sum(1), longest, host_digits + of_host[:, ord(".")] == host_size,
        [suffixes.get(x.rpartition(".")[2], 0.0) for x in hosts],
    )
    for k, v in enumerate(columns):
        out[:, k] = v
    return out


def training_urls() -> list[tuple[str, str, int]]:
    """The small labelled table: (URL, host, 1 for block), written by rules from a fixed seed."""
    rng = np.random.default_rng(17)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(of[i] for i in rng.integers(0, len(of), n))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    mixed = "abcdefghijklmnopqrstuvwxyz0123456789"
    words = [letters(int(rng.integers(3, 9))) for _ in range(200)]
    out = []
    for _ in range(600):
        host = ".".join([*([pick(["www", "blog", "m", "docs", "en"])] if rng.integers(2) else []), pick(words), *(["example"] if rng.integers(2) else []), pick(["com", "org", "net", "edu", "de", "fr", "es"])])
        path = "/" + "/".join(pick([pick(words), str(rng.integers(1, 99999)), pick(["en", "de", "fr", "es"]), f"{pick(words)}-{pick(words)}"]) for _ in range(int(rng.integers(0, 4))))
        out.append((f"{pick(['http', 'https'])}://{host}{path}{pick(['', '', '/', '.html', '?page=2&ref=x', '?utm_source=feed', '#top', '?id=' + str(rng.integers(1, 999))])}", host, 0))
        kind = int(rng.integers(4))
        if kind == 0:  # addresses instead of names
            host = ".".join(str(x) for x in rng.integers(1, 255, 4))
            url = f"http://{host}/{letters(12, mixed)}/{letters(8, mixed)}.php?{letters(6)}={letters(16, mixed)}&{letters(4)}={letters(10, mixed)}"
        elif kind == 1:  # stuffed hosts
            host = "-".join(pick(words) for _ in range(int(rng.integers(4, 7)))) + f"{rng.integers(100, 9999)}." + pick(["xyz", "top", "click", "win", "com", "info"])
            url = f"http://{host}/{letters(10, mixed)}?aff={rng.integers(1000, 99999)}&sub={letters(12, mixed)}"
        elif kind == 2:  # many parameters
            host = f"{letters(10, mixed)}.{pick(words)}." + pick(["com", "net", "biz", "info", "top"])
            url = f"https://{host}/{letters(5)}?" + "&".join(f"{letters(4)}={letters(14, mixed)}%{rng.integers(10, 99)}" for _ in range(int(rng.integers(5, 12))))
        else:  # deep paths of random words
            host = f"{letters(24, mixed)}." + pick(["top", "xyz", "click", "ru", "com"])
            url = f"http://{host}/" + "/".join(letters(14, mixed) for _ in range(int(rng.integers(5, 10))))
        out.append((url, host, 1))
    return out


#: Bound of the labelled sample that a model is fitted on.
TRAIN_ROWS = 50_000


def fit_table(labelled: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """A model from ``labelled`` (url, label: 1 for block), of which at most about ``max_rows`` rows are read."""
    rows = labelled.filter("url is not null and label is not null").select(F.col("url").cast("string").alias("url"), F.col("label").cast("int").alias("label"))
    some = T.bounded(rows, max_rows, "url").withColumn("host", host_of(F.col("url")))
    return _fit([(r["url"], r["host"], r["label"]) for r in some.orderBy("url").collect()])


@lru_cache(1)
def fit() -> Model:
    """The model of the written table."""
    return _fit(training_urls())


def _fit(rows: list[tuple[str, str, int]]) -> Model:
    """Suffix statistics (smoothed log odds of block) and trees."""
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for _, host, y in rows:
        seen[host.rpartition(".")[2]][y] += 1
    suffixes = {s: float(np.log((b + 1) / (a + 1))) for s, (a, b) in seen.items() if a + b >= 10 and not s.isdigit()}
    x = lexical([r[0] for r in rows], [r[1] for r in rows], suffixes)
    return Model(gbt.fit(x, np.array([r[2] for r in rows], float), trees=40, depth=3), suffixes)


def judge(pages: DataFrame, rules: list[Rule], model: Model | None = None) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict (allow or block) and score (of the trees)."""
    sent = pages.sparkSession.sparkContext.broadcast(model or fit())  # a model of fixed size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = sent.value.forest.score(lexical(batch.column("url").to_pylist(), batch.column("host").to_pylist(), sent.value.suffixes))
        cols = {c: batch.column(c) for c in ("page_id", "host", "path")} | {"score": pa.array(s)}
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    url = F.col("url").cast("string")
    read = pages.select("page_id", F.coalesce(url, F.lit("")).alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    kind = dict(pages.dtypes)["page_id"]
    scored = T.by_batch(read, run, f"page_id {kind}, host string, path string, score double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= BLOCK, "block").otherwise("allow")).alias("verdict"), "score")
