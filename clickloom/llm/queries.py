"""The operators with production parameters over the whole test tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from clickloom.llm import decontaminate, fingerprint, language, maxent_lm, minhash, mixing, pii, ranked, spelling, token_counts, token_files, toxicity, url_filter
from clickloom.llm.common import table

#: End-of-document id of op7 and the name of its tokenizer file.
END_ID, TOKENIZER = 2, "word_bpe_49k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


URL_RULES = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)


@query
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_filter.judge(table(spark, folder, "pages"), URL_RULES)
    return judged.withColumnRenamed("id", "page_id")


@query
def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.components(table(spark, folder, "documents"), shingle=4, percent=80)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"),
        F.col("id").eqNullSafe(F.col("first.id")).alias("kept"),
    )


@query
def op3_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    printed = texts.withColumn("lanes", fingerprint.lanes(F.col("text")))
    pairs = fingerprint.with_next(printed, "doc_id", ["text", "lanes"])
    pairs = pairs.withColumn("edited", fingerprint.edited(F.col("text"), F.col("next.text")))
    pairs = pairs.withColumn("edited_lanes", fingerprint.lanes(F.col("edited")))
    return pairs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.text_form(F.col("lanes")).alias("fingerprint"),
        fingerprint.text_form(F.col("edited_lanes")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        fingerprint.likeness(F.col("lanes"), F.col("next.lanes")).alias("near_next"),
    )


@query
def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontaminate.judged(found).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


ORACLES["op4_benchmark_decontamination"] = decontaminate.SQL


@query
def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = pii.find(docs, pii.fit(docs))
    form = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), *map(count, pii.KINDS), F.sha2(form("base"), 256).alias("base_sha256"), form("spans").alias("spans"),
    )


@query
def op6_language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    cut = maxent_lm.tokenized(docs)
    return maxent_lm.score(maxent_lm.fit(docs, cut=cut), docs, cut=cut).withColumnRenamed("id", "doc_id")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query
def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    segments = token_files.write(table(spark, folder, "documents"), tokenizer_path(), END_ID)
    return token_files.read_index(segments)


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    pieces = token_counts.vocabulary(tokenizer_path())
    return token_counts.count(table(spark, folder, "documents"), pieces).withColumnRenamed("id", "doc_id")


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = docs.select(
        "doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), toxicity.scores(model, F.col("text")).alias("score"),
    )
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


@query
def op10_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLES["op10_mix_sources"] = mixing.SQL


@query
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    best = ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)
    return best.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


ORACLES["op11_ranked_search"] = ranked.SQL


@query
def op12_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs.filter(~language.is_held_out(F.col("doc_id"))))
    found = language.predict(model, docs)
    return found.select(F.col("id").alias("doc_id"), "held_out", F.col("lang").alias("lang_pred"), "score", "languages")


@query
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling.count_words(table(spark, folder, "documents"), min_length=6, min_count=5, typo_every=199)
    return spelling.variants(words, ratio=5)


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
