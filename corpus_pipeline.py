"""From raw documents to encoded training data in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
Stages follow each other in the same executors, so each begins by giving back the heap that those
before it needed, and their Python workers get small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import lsm_dedup, mixing, ngram_join, sentencepiece_bpe, toxicity
from paperloom.llm.common import remove, scratch, shrink_heaps, small_batches, table, write_table
from paperloom.llm.queries import tokenizer_path


def begin(spark: SparkSession) -> None:
    shrink_heaps(spark)
    small_batches(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    begin(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that with the largest doc_id."""
    begin(spark)
    return lsm_dedup.drop_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    begin(spark)
    return ngram_join.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of each source by its target; what is taken twice gives two rows."""
    begin(spark)
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row that the mix took."""
    begin(spark)
    return sentencepiece_bpe.encode_decode(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode),
]

#: The Jaccard join and the encoder cannot be stated in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote for itself is deleted once its result is
    written, and that once the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            path, docs = write_table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
            keep.append(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
