"""From documents to packed training sequences: the stages that the text operators make up.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and
read again as the next one's ``docs``. All but the last return the columns of documents.

Defined results: a null text counts as empty in every stage, and comes out of the passages
stage as the empty text; rows with a null id are judged and stay, and their pieces carry the
null id; of rows that repeat an id one is left by the near-duplicate stage; of equal texts the
smallest id stays; a text that was all repeats goes with its row; an empty table gives no
pieces. Further columns of documents are carried to the passages stage and dropped by packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from accordant.llm import cotraining, near_dedup, packing, suffix_dedup, toxicity
from accordant.llm.common import documents
from accordant.llm.queries import WORD_BPE, labels, tokenizer
from accordant.session import cut_lineage, discard, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers find good."""
    return cotraining.keep(docs, labels(spark, sf_dir))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    return toxicity.keep(docs, labels(spark, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    return near_dedup.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier in the corpus."""
    return suffix_dedup.without_repeats(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 4096 tokens."""
    # workers have run four stages by now, so the cache is kept small
    return packing.pack(docs, tokenizer(WORD_BPE), most_stretches=120_000)


STAGES = [
    ("quality", quality),
    ("toxicity", clean),
    ("near_duplicates", distinct),
    ("repeated_passages", passages),
    ("packing", sequences),
]
#: Trained classifiers and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = documents(spark, sf_dir), None
    for i, (_, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        already = scratch()
        docs = cut_lineage(stage(spark, docs, sf_dir))
        # the result is written, so what the stage wrote before it and its input may go
        discard(spark, [x for x in scratch()[:-1] if x not in already or x == own])
        own = scratch()[-1]
