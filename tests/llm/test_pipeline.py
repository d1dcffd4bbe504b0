"""Stages of the pipeline on small planted inputs."""

from __future__ import annotations

import corpus_pipeline
from engramlake.llm import langid

SAID = {
    "de": "der alte Mann ging langsam über die Straße und kaufte ein Brot für seine Kinder",
    "en": "the old man walked slowly across the street and bought some bread for his children",
    "es": "el viejo hombre caminaba despacio por la calle y compraba pan para sus hijos",
    "fr": "le vieil homme marchait lentement dans la rue et achetait du pain pour ses enfants",
}


def test_pipeline_keeps_text_of_many_languages(spark):
    mixed = "\n".join(SAID.values())
    rows = [(k * 4 + i, t, lang) for k in range(5) for i, (lang, t) in enumerate(SAID.items())]
    docs = spark.createDataFrame([*rows, (90, mixed, None), (91, "12 34 !", None), (92, None, None)], "doc_id long, text string, lang string")
    score = langid.with_language(docs, langid.fit(docs)).filter("doc_id = 90").first().lang_score
    assert score < 0.4
    got = {r.doc_id: r.lang for r in corpus_pipeline.languages(spark, docs, "").collect()}
    assert got == {i: lang for i, _, lang in rows} | {90: got.get(90)}
    assert got[90] in SAID
