"""From raw documents to token files: five stages, each over all rows that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import decontaminate, minhash, mixing, token_files, toxicity
from clickloom.llm.common import table, written

#: A document is rejected from this toxicity score on.
TOXIC_FROM = 0.3
END_ID, TOKENIZER = 2, "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents below the toxicity threshold, by a model learned from ``labels``."""
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return docs.filter(toxicity.scores(model, F.col("text")) < TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the one with the smallest id."""
    return minhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark passage."""
    return decontaminate.without_contaminated(docs, table(spark, folder, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of each source as often as its target weight asks for, three times at most."""
    return mixing.mixed_rows(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token files, and what reading them back gives for each document."""
    import public_tokenizers

    segments = token_files.write(docs, public_tokenizers.path(TOKENIZER), END_ID)
    return token_files.read_index(segments)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]
#: No SQL trains the toxicity model; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each result is written as parquet and read back for the next."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, folder), f"pipeline-{name}")
    return docs
