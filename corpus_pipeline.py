"""A corpus made ready for training in five stages: quality rules, line dedup, near-duplicate removal, mixing of sources, and BPE ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. What a stage
returns is written as Parquet and read again for the next.

Null texts, empty ones and those of white space go in the first stage; null languages and sources are groups of their own throughout.
Rows that repeat a doc_id are judged each, cut in the order of a hash of their texts, one document where near copies are looked for,
and taken or left together by the mix. Rows with a null doc_id stay where their texts do. Columns beyond those of ``documents`` are
carried along, whatever their names, up to the last stage. An empty table gives an empty result, and texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, line_dedup, minhash, mixing, quality_rules
from tidemark.llm.common import documents, has_word, release, tuned, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Short documents are judged like others: the least number of words is one."""
    return quality_rules.passing(docs, min_words=1)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut out of texts; a document of which no word is left goes."""
    cut = line_dedup.without_repeated_lines(docs).where((F.col("n_deleted") == 0) | has_word(F.col("text")))
    own = {"text": F.col("text"), "n_chars": F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("d.n_chars"))}
    return cut.select(*[own[c].alias(c) if c in own else F.col("d").getField(c).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    release(spark)  # what the stage before has dealt out
    return minhash.without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come to their target weights."""
    release(spark)
    return mixing.repeated(docs, mixing.mix(docs))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and the ids."""
    release(spark)
    return bpe.encode(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Stages use tokenizers and sketches that SQL can't express; tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = documents(tuned(spark), sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
