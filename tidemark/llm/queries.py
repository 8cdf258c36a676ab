"""The operators of this subpackage as named queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    byte_bpe,
    decontaminate,
    filter_audit,
    html_text,
    mixing,
    nearest,
    pii,
    prefix_trie,
    pseudo_likelihood,
    quality,
    secret_scan,
    simhash,
    toxicity,
)
from tidemark.llm.common import table


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    held_out = F.coalesce(held_out, F.lit(False)).alias("held_out")
    return toxicity.toxicity(docs, model).select("doc_id", held_out, "score", "predicted")


def op3_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.pseudo_likelihood(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_text.main_text(pages, html_text.fit(pages))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secret_scan.BASE]
    base = F.filter("secrets", lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id",
        *[_count("secrets", k).alias(f"n_{k}") for k in kinds],
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("secrets")).alias("spans"),
    )


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.personal_data(docs, pii.fit(docs))
    return found.select(
        "doc_id",
        *[_count("pii.base", k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(secret_scan.listed(F.col("pii.base")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("pii.spans")).alias("spans"),
    )


def op9_benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("found.hits", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "found", n_hit.alias("n_hit")).select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        "n_hit",
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.search(nearest.index(vectors), vectors.where("vec_id % 50 = 0"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = byte_bpe.byte_bpe(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    return found.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_soft_mixing": op1_soft_mixing,
        "op2_toxicity": op2_toxicity,
        "op3_pseudo_likelihood": op3_pseudo_likelihood,
        "op4_cotrained_quality": op4_cotrained_quality,
        "op5_simhash_near_duplicates": op5_simhash_near_duplicates,
        "op6_main_text": op6_main_text,
        "op7_secret_scan": op7_secret_scan,
        "op8_personal_data": op8_personal_data,
        "op9_benchmark_contamination": op9_benchmark_contamination,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "op11_filter_audit": op11_filter_audit,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_byte_bpe": op13_byte_bpe,
    }
