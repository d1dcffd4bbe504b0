"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

from collections.abc import Callable

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from engramlake.llm import decontaminate, langid, licenses, neardup, packing, perplexity, pii, quality, toxicity, urlfilter

SAID = {
    "de": "der alte Mann ging langsam über die Straße und kaufte ein Brot für seine Kinder am Morgen, als es noch kalt war und niemand sonst unterwegs",
    "en": "the old man walked slowly across the street and bought some bread for his children in the morning, while it was cold and nobody else was out",
}
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
LONG = "a very long text that goes on and on, and has no end\n" * 20_000 + "but for a number 12345"
EXTRA = ("_h", "_n", "n", "h", "h1", "rep", "label", "score", "key", "x", "y", "size", "bucket", "lang_pred", "items", "kept", "path", "host", "base", "added", "held_out")
ROWS = [
    (1, SAID["en"], "en"), (2, SAID["de"], "de"), (3, SAID["en"], "en"), (3, SAID["en"], "en"), (4, None, None), (5, "", "en"), (6, " \n\t ", None), (7, LONG, "en"), (8, "12 34 !", None),
    (9, f"{SAID['en']} {PASSAGE} {SAID['en']}", "en"), (10, "write to ann@example.org or call +1 555 123 4567 89", "en"), (None, SAID["de"], "de"), (None, None, None), (11, "ß" * 50, "de"),
]


def docs(spark: SparkSession, rows: list = ROWS) -> DataFrame:
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return d.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), **{c: F.lit("mine") for c in EXTRA}})


def labels(spark: SparkSession, rows: list | None = None) -> DataFrame:
    rows = [(1, 0, 0), (2, 1, 1), (2, 1, 1), (3, None, None), (None, 1, 1), (99, 1, 0)] if rows is None else rows
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("y", F.lit("mine"))


def benchmark(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (None, PASSAGE)], "item_id long, text string").withColumn("_n", F.lit("mine"))


def urls(spark: SparkSession, rows: list) -> DataFrame:
    pages = [(r[0], None if r[1] is None else "http://example.com/" + r[1][:2000]) for r in rows]
    return spark.createDataFrame(pages, "page_id long, url string").withColumns({"html": F.lit(""), **{c: F.lit("mine") for c in EXTRA}})


OPERATORS: dict[str, Callable[[SparkSession, list], DataFrame]] = {
    "decontaminate": lambda s, r: decontaminate.digest(decontaminate.find_overlaps(docs(s, r), benchmark(s))),
    "neardup": lambda s, r: neardup.near_duplicates(docs(s, r)),
    "langid": lambda s, r: langid.label(docs(s, r), langid.fit(docs(s, r))),
    "toxicity": lambda s, r: toxicity.score(docs(s, r), toxicity.fit(docs(s, r), labels(s))),
    "packing": lambda s, r: packing.pack(docs(s, r)),
    "licenses": lambda s, r: licenses.scan(docs(s, r)),
    "quality": lambda s, r: quality.score(docs(s, r), quality.fit(docs(s, r), labels(s), "quality")),
    "pii": lambda s, r: pii.digest(pii.find(docs(s, r))),
    "urlfilter": lambda s, r: urlfilter.judge(urls(s, r), [("block", "example.com/")]),
    "perplexity": lambda s, r: perplexity.rules(docs(s, r)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_odd_rows(spark, name):
    got = OPERATORS[name](spark, ROWS).collect()
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(tuple(r)[1:])
    assert set(by) == {r[0] for r in ROWS}
    if name != "packing":
        assert len(got) == len(ROWS)
        assert by[3][0] == by[3][1]  # repeated rows have equal results
    if name not in ("packing", "neardup"):
        assert by[1] == [by[3][0]]  # and so do equal texts
    if name not in ("packing", "urlfilter", "neardup"):
        assert by[4] == by[5] or name == "perplexity"  # null counts as empty


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_an_empty_table(spark, name):
    assert OPERATORS[name](spark, []).collect() == []


def test_learned_operators_without_labels(spark):
    none = labels(spark, [])
    d = docs(spark)
    assert {r.score for r in quality.score(d, quality.fit(d, none, "quality")).collect()} == {0.5}
    assert len(toxicity.score(d, toxicity.fit(d, none)).collect()) == len(ROWS)
    bare = d.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.label(d, langid.fit(bare)).collect()} == {"und"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs(spark).coalesce(1).write.parquet(f"{at}/documents.parquet")
    benchmark(spark).coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_on_odd_rows(spark, folder):
    """Each stage keeps the columns, and what it should; the last one packs what is left."""
    d = spark.read.parquet(f"{folder}/documents.parquet")
    wanted = [{1, 2, 3, 7, 9, 10, 11, None}, {1, 2, 7, 9, 10, 11, None}, {1, 2, 7, 10, 11, None}, {1, 2, 7, 10, 11, None}]
    for (_, stage), ids in zip(corpus_pipeline.STAGES[:-1], wanted, strict=True):
        out = stage(spark, d, folder)
        assert out.schema.names == d.schema.names
        rows = out.collect()
        assert {r.doc_id for r in rows} - {None, 2} == ids - {None, 2}
        assert {r.doc_id for r in rows} & {None, 2}  # of two equal texts, one of which has no id, one stays
        assert all(r[c] == "mine" for r in rows for c in EXTRA)
        d = spark.createDataFrame(rows, out.schema)
    left = {r.doc_id: r for r in d.collect()}
    assert left[10].text == "write to [EMAIL] or call [PHONE]" and left[10].n_chars == len(left[10].text)
    assert left[1].text == SAID["en"]
    packed = corpus_pipeline.STAGES[-1][1](spark, d, folder).collect()
    assert {r.doc_id for r in packed} == set(left)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole} == {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed}


def test_stages_on_an_empty_table(spark, folder):
    d = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, folder).collect() == []
