"""The whole job on small planted inputs: nothing is left out because of its size, wording or letters."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engramlake.llm import decontaminate, langid, licenses, neardup, packing, perplexity, toxicity, urlfilter
from engramlake.llm import text as T

WORDS = "the quick brown fox jumps over a lazy dog while seven grey geese watch from their river bank".split()
TEXTS = [" ".join(WORDS[(i * 7 + j * j) % len(WORDS)] for j in range(25 + i)) for i in range(12)]


def kneser_ney(texts: list[str]) -> list[float]:
    """Mean negative log probability of each text's characters, by dictionaries."""
    padded = ["\n\n\n" + t for t in texts]
    counts = [Counter(p[i - 3 : i + 1] for p in padded for i in range(3, len(p)))]
    for _ in range(3):
        counts.append(Counter(g[1:] for g in counts[-1]))
    p: dict[str, float] = defaultdict(lambda: 1 / 0x110000)
    for c in reversed(counts):
        of = [sum(n == i for n in c.values()) for i in range(1, 5)]
        y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.5
        d = [0, *[min(i, max(0.1, i - (i + 1) * y * of[i] / of[i - 1])) if of[i - 1] else 0.5 for i in (1, 2, 3)]]
        total, cuts = Counter(), Counter()
        for g, n in c.items():
            total[g[:-1]] += n
            cuts[g[:-1]] += d[min(n, 3)]
        p |= {g: (n - d[min(n, 3)]) / total[g[:-1]] + max(cuts[g[:-1]] / total[g[:-1]], 1e-9) * p[g[1:]] for g, n in c.items()}
    return [-sum(math.log(p[x[i - 3 : i + 1]]) for i in range(3, len(x))) / (len(x) - 3) for x in padded]


def test_op10_model_of_all_characters(spark):
    texts = [*TEXTS, TEXTS[0].replace("e", "é"), TEXTS[1].replace("e", "漢")]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (90, ""), (91, None)], "doc_id long, text string")
    model = perplexity.fit(docs)
    assert model.count() == len({g for t in texts for x in ["\n\n\n" + t] for g in (x[i - 3 : i + 1] for i in range(3, len(x)))})
    want = kneser_ney([*texts, texts[0]])
    for most in (perplexity.SLICE, 100):  # a size that makes many slices of the model changes nothing
        got = [(r.doc_id, r.log_perplexity, r.n_words) for r in perplexity.measure(docs, model, most).collect()]
        assert len(got) == len(texts) + 3
        for i, x, n in got:
            assert x is None if i >= 90 else math.isclose(x, want[i], rel_tol=1e-9)
            assert n == (0 if i >= 90 else len(texts[i].split()))


def ways(text: str, insults: dict[str, float] | None = None) -> dict[str, float]:
    """The clause sums of one text, for a lexicon of the given words."""
    words = [np.frombuffer(w.encode(), np.uint8) for w in insults or {}]
    h = np.array([T.Hasher(b)(np.array([0]), np.array([len(b)]))[0] for b in words], np.uint64)
    order = np.argsort(h)
    lexicon = toxicity.Lexicon(h[order], np.array(list((insults or {}).values()), float)[order])
    return dict(zip(toxicity.WAYS, toxicity.clause_sums(next(T.chunks(pa.array([text]))), lexicon)[0], strict=True))


@pytest.mark.parametrize(
    ("machine", "symbol", "reach"), [(toxicity.THREAT, 1, 3), (toxicity.TARGET, 2, 3), (toxicity.NEGATION, 3, 3), (toxicity.REPORT, 4, None)], ids=["threat", "target", "negation", "report"]
)
def test_op4_each_machine(machine, symbol, reach):
    state, seen = 0, []
    for a in (0, symbol, 0, 0, 0, 0, 0):
        seen.append(state > 0)
        state = machine.arcs[state, a]
    seen.append(state > 0)
    n = 6 if reach is None else reach
    assert seen == [False, False, *[True] * n, *[False] * (6 - n)]


def test_op4_composition():
    """The composed machine does what its parts do side by side."""
    rng = np.random.default_rng(1)
    parts = (toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT)
    whole, state, each = toxicity.FROM_LEFT, 0, [0] * 4
    for a in rng.integers(0, 5, 500):
        state = whole.arcs[state, a]
        each = [m.arcs[s, a] for m, s in zip(parts, each, strict=True)]
        assert [whole.of(k)[state] for k in range(4)] == each


@pytest.mark.parametrize(
    ("text", "way"),
    [
        ("I will kill you", "menace"),
        ("ich werde dich schlage", "menace"),
        ("I will not kill you", "menace_off"),
        ("he said kill them", "menace_off"),
        ("beat the drum, and you slept", None),
        ("kill one two three four you", None),
    ],
)
def test_op4_threat_without_insult(text, way):
    got = ways(text)
    assert [k for k in ("menace", "menace_off") if got[k]] == ([way] if way else [])


@pytest.mark.parametrize(
    ("text", "way"),
    [
        ("what a grobnik", "plain"), ("you are a grobnik", "aimed"), ("a grobnik are you", "aimed"), ("that is not a grobnik", "negated"), ("she said he is a grobnik", "reported"), ("kill that grobnik", "threat"),
        ("not here. a grobnik", "plain"), ("grobnik one two three four you", "plain"),
    ],
)
def test_op4_ways_of_an_insult(text, way):
    got = ways(text, {"grobnik": 2.0})
    assert {k for k in toxicity.WAYS[:5] if got[k]} == {way}


def test_op4_long_clause():
    got = ways("you " * 300_000 + "grobnik " * 3, {"grobnik": 2.0})
    assert np.isclose(got["aimed"], np.log1p(6.0))


def test_op4_unseen_threat_scores_above_clean(spark):
    texts = [(i, f"plain words number {i} " + ("grobnik" if i % 2 else "")) for i in range(80)]
    docs = spark.createDataFrame([*texts, (900, "I will kill you"), (901, "I will meet you")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert score[900] > 0.5 > score[901]


@pytest.mark.parametrize("rows", [10**6, 5 * 10**10, 10**13])
def test_bounded_sample_is_never_empty(spark, rows):
    """The threshold keeps the wanted share of a table of any size."""
    drawn = spark.range(200_000)
    kept = T.bounded(drawn, rows // 100, "id", rows=rows).count()
    assert 1_700 < kept < 2_300
    assert T.bounded(drawn, 12_000, "id", rows=rows)._jdf.queryExecution().analyzed().toString().count("< 0") == 0


def test_op1_long_matches_and_many_blocks(spark):
    item = " ".join(f"w{i % 37}x{i}" for i in range(200))
    words = item.split()
    rows = [(1, "a b " + " ".join(words[20:120]) + " c"), (2, " ".join(words[:9])), (3, None), (4, "W0X0 short text"), (5, " ".join(words[20:31]).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_h": F.lit("keep"), "_n": F.lit(7), "items": F.lit("mine")})
    bench = spark.createDataFrame([("long", item), ("tiny", "w0x0 short"), ("none", ""), (None, "a b")], "item_id string, text string")
    want = decontaminate.find_overlaps(docs, bench).select("doc_id", "items", "longest", "longest_start", "longest_item").collect()
    assert {r.doc_id: (r.items, r.longest, r.longest_start) for r in want} == {1: (["long"], 100, 2), 2: ([], 0, None), 3: ([], 0, None), 4: (["tiny"], 2, 0), 5: (["long"], 11, 0)}
    small = decontaminate.find_overlaps(docs, bench, block_words=300).select("doc_id", "items", "longest", "longest_start", "longest_item").collect()
    assert sorted(small) == sorted(want)
    for block in (decontaminate.BLOCK_WORDS, 300):
        kept = decontaminate.decontaminate(docs, bench, block_words=block).collect()
        assert sorted((r.doc_id, r._h, r._n, r.items) for r in kept) == [(2, "keep", 7, "mine"), (3, "keep", 7, "mine")]


def test_op9_learns_from_a_given_table(spark):
    good = [(f"https://www.site{i}.org/news/{i}", 0) for i in range(150)]
    bad = [(f"http://x{i * 7919 % 10007}.biz/{'/'.join(['q9z8y7'] * 6)}?a={i}&b={i}&c={i}&d={i}", 1) for i in range(150)]
    model = urlfilter.fit_table(spark.createDataFrame([*good, *bad, (None, 1), ("http://a.org", None)], "url string, label int"))
    pages = spark.createDataFrame([(1, "https://www.other.org/news/77"), (2, "http://zz999.biz/q9z8y7/q9z8y7/q9z8y7/q9z8y7/q9z8y7?a=1&b=2&c=3&d=4"), (3, "http://zz999.biz/q9z8y7/q9z8y7/q9z8y7/q9z8y7/q9z8y7?a=1&b=2&c=3&d=4"), (4, None)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, [("allow", "never.example/")], model).collect()}
    assert got[1] == (None, "allow") and got[2] == got[3] == (None, "block") and set(got) == {1, 2, 3, 4}
    ruled = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, [("allow", "biz/")], model).collect()}
    assert ruled[2] == ("biz/", "allow")  # a rule goes before the trees


def test_op9_written_table_blocks_spam(spark):
    urls = ["http://81.17.4.9/x8f2kq9vhs1a/7hd73hd9.php?sid=88hd8h3hd83h8d3h&tok=9d83jd93jd", "https://en.example.org/wiki/Spark"]
    got = [r.verdict for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), []).orderBy("page_id").collect()]
    assert got == ["block", "allow"]


def test_op6_wrapped_unknown_and_plain(spark):
    texts = [
        "Some prose first.\nPermission is hereby granted, free of charge,\nto any person obtaining a copy\nof this software\nNext Line", "All rights reserved.", "A story of a river and its source.\nIt was public.", "",
        None,
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [x.family for x in got[0].licences] == ["mit"] and got[0].n_paragraphs == 3
    assert got[1].licence == "reserved" and got[2].licence == "none"
    assert (got[3].n_paragraphs, got[3].licence, got[4].licence) == (0, "none", "none")


def test_op6_licence_in_words_of_its_own(spark):
    text = "Permission is granted to use the software under a licence of our own making, without warranty of any kind"
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.licence in ("unknown", "mit")


def test_op5_patterns_are_always_fitted():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 2049, 5000), rng.integers(1, 60, 5000), np.full(500, 700), np.array([2048] * 9 + [1]), np.zeros(0, int)):
        hist = np.bincount(lengths, minlength=2049)
        plan = packing.plan_patterns(hist, 2048)
        used = np.zeros(2049, int)
        for p, k in plan:
            assert sum(p) <= 2048
            np.add.at(used, list(p), k)
        assert (used == hist).all()
        least, plain = -(-int(lengths.sum()) // 2048), sum(k for _, k in packing.best_fit(hist, 2048))
        assert least <= sum(k for _, k in plan) <= plain * 1.005 + 2


def test_op2_parts_of_buckets_lose_no_link(spark):
    """Texts on one template, of many lengths, with links between neighbours in length only: as all pairs give them."""
    rng = np.random.default_rng(5)
    head = [f"t{i}" for i in range(40)]
    rows = [(i, " ".join(head + [f"d{i // 3}x{j}" for j in range(int(n))])) for i, n in enumerate(rng.integers(4, 40, 90))]
    docs = spark.createDataFrame([*rows, (200, " ".join(head)), (201, ""), (202, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 2, 80).collect()}
    assert got == neardup.brute_force([(r.doc_id, r.text) for r in docs.collect()], 2, 80)
    assert neardup.near_duplicates(docs, 2, 100).count() == 93


def test_op5_sequences_come_from_fitted_patterns():
    """Most sequences are of enumerated patterns, which best fit alone does not make, and about as few as it needs."""
    rng = np.random.default_rng(8)
    lengths = np.minimum(2048, rng.lognormal(6.4, 0.8, 20_000).astype(int) + 1)
    hist = np.bincount(lengths, minlength=2049)
    plan, left = packing.fitted_patterns(hist, 2048)
    fitted, rest = sum(k for _, k in plan), sum(k for _, k in packing.best_fit(left, 2048))
    assert fitted >= 4 * rest
    assert all(0.998 * 2048 <= sum(p) <= 2048 for p, _ in plan)
    plain = dict(packing.best_fit(hist, 2048))
    assert sum(k for p, k in plan if p not in plain) >= 0.25 * fitted
    assert fitted + rest <= 1.01 * lengths.sum() / 2048 + 1


def test_op3_knows_200_languages(spark):
    rng = np.random.default_rng(4)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(12)] for _ in range(200)]
    rows = [(200 * j + i, " ".join(rng.choice(words[i], 12)), f"l{i:03d}") for i in range(200) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.label(docs, langid.fit(docs)).collect()
    want = {i: x for i, _, x in rows}
    assert sum(r.lang_pred == want[r.doc_id] for r in got) >= 0.98 * len(rows)
    assert {r.lang_pred for r in got} > {f"l{i:03d}" for i in range(120, 190)}
    few = langid.fit(spark.createDataFrame([*rows, *[(10_000 + i, "den und der die das", "de") for i in range(3000)]], docs.schema), max_rows=900)
    assert len(few.langs) == 201  # rare ones are learned, whatever the sample


@pytest.mark.parametrize("window", [13, 17, 30])
def test_op1_windows_of_any_length(spark, window):
    words = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([("a", " ".join(words))], "item_id string, text string")
    texts = [" ".join(["x", *words[5 : 5 + window], "y"]), " ".join(["x", *words[5 : 4 + window], "y"]), " ".join([*words[: window - 1], "z", *words[window : window + 5]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (sum(b - a for a, b in zip(r.hit_starts, r.hit_ends, strict=True)), r.longest) for r in decontaminate.find_overlaps(docs, bench, window).collect()}
    assert got == {0: (window, window), 1: (0, 0), 2: (0, 0)}
