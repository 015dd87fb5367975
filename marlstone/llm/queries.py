"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import bpe, exactdedup, jaccard, ngram_lm, packing, quality, secret_scan, suffix_dedup, tokenids, toxicity
from marlstone.llm.common import documents

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = ngram_lm.fit(documents(spark, sf_dir), folds=10)
    return ngram_lm.score(model, rows)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(documents(spark, sf_dir), length=200)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secret_scan.secrets(docs, secret_scan.fit(docs))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), WORD_BPE)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.token_files(documents(spark, sf_dir), BYTE_BPE)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.toxicity(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=5), folds=5)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(documents(spark, sf_dir), shingle=4, percent=85)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), BYTE_BPE, capacity=1024)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {
        "op10_exact_dedup": r"""
            WITH d AS (
              SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
            )
            SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM d WINDOW w AS (PARTITION BY t ORDER BY chars DESC, doc_id)""",
    }
