"""One query per operator, over its whole table; ``queries`` and ``oracles`` for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.llm import (
    cotraining, fingerprints, html_text, licences, near_dedup, packing, phrases, prefix_bpe, rules, spelling, suffix_dedup, token_files, toxicity,
)
from accordant.llm.common import documents
from accordant.session import cut_lineage

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
MULTI_BPE = "byte_bpe_multi_50k.tiktoken"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.folder(spark)
    token_files.write(documents(spark, sf_dir), tokenizer(BYTE_BPE), path)
    stored = token_files.read(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return token_files.with_start(cut_lineage(stored)).select("doc_id", "start", "n_tokens", "ids_crc32", "part", "shard", "place")


def op4_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pieces(documents(spark, sf_dir), tokenizer(WORD_BPE))
    stored = cut_lineage(made.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packing.place(stored)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.against_edits(documents(spark, sf_dir))
    return found.withColumn("edited", F.sha2("edited", 256)).withColumnRenamed("edited", "edited_sha256")


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer(MULTI_BPE)
    coded = prefix_bpe.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return prefix_bpe.decode(coded, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(documents(spark, sf_dir), slips=97)


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op")}


def oracles() -> dict[str, str]:
    return {"op1_licence_scan": licences.oracle(), "op13_phrases": phrases.oracle()}
