"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, mixing, token-ID output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. A stage first deletes what the ones before it left in
scratch, as their results are written by then; documents that are not written yet keep what they are read from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assetlens.llm import decontaminate, language, mixing, ngram_join, simple8b
from assetlens.llm.common import discard, job, store, table

END_ID = 2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those of too low a confidence, go."""
    with job(docs, "language_id"):
        return language.without_rejected(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest doc_id stays."""
    with job(docs, "ngram_join"):
        return ngram_join.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a whole shorter item) go."""
    with job(docs, "decontamination"):
        return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    with job(docs, "mixing"):
        return mixing.mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files that it writes."""
    import public_tokenizers

    with job(docs, "token_ids"):
        return simple8b.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: Language ID and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
