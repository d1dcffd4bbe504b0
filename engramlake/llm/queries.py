"""The queries of the training-data operators, each over its whole table, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm import audit, decontaminate, langid, licenses, neardup, packing, perplexity, pii, quality, runs, superkmers, toxicity, urlfilter
from engramlake.llm.text import crc_part

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(df: DataFrame, parts: int, part: int) -> DataFrame:
    return df.withColumn("held_out", F.coalesce(crc_part(df, "doc_id", parts) == part, F.lit(False)))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, threshold=80)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(crc_part(docs, "doc_id", 4) != 2))
    found = langid.label(docs, model)
    return _held_out(found, 4, 2).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(crc_part(labels, "doc_id", 3) != 1))
    found = _held_out(toxicity.score(docs, model), 3, 1)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(crc_part(labels, "doc_id", 5) != 0), "quality")
    found = _held_out(quality.score(docs, model), 5, 0)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


#: The contract's fixed rules.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))), ",")
    return found.select("doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"), names.alias("families"), "n_unknown", "licence")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = perplexity.rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.remove(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.detect(table(spark, sf_dir, "documents"), planted=True).drop("runs", "n_words", "n_dropped")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository, beside the package

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = (
        op1_decontamination, op2_near_duplicates, op3_language, op4_toxicity, op5_packing, op6_licenses,
        op7_quality, op8_personal_data, op9_urls, op10_quality_rules, op11_filter_audit, op12_substring_dedup, op13_periodic_runs, pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": audit.SQL, "op12_substring_dedup": superkmers.SQL}
