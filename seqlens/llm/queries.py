"""The query of each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.llm import decontaminate, html_extract, language_id, packing, pii, quality, sharding, simhash, spelling, substrings, tokenizer_fst, topk
from seqlens.llm.common import checkpointed, table

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
#: A deployment gives its own; a fixed key makes this query's result repeatable.
PII_KEY = "seqlens-demonstration-key"
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = language_id.held_out(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    profiles = language_id.fit_profiles(docs.where(~F.col("held_out")))
    found = language_id.identify(docs, profiles)
    return language_id.held_out(found).select("doc_id", "held_out", "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", *quality.BASE, "base_failed", "kept", "good")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_entities")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()).withColumn("ids_crc32", F.crc32("token_ids")).drop("token_ids")
    return packing.balanced_steps(checkpointed(pieces)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), SHARDS)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokenizer_fst.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return tokenizer_fst.with_limit(counts, TOKEN_LIMIT)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, model=html_extract.fit(pages))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_simhash": op2_simhash,
        "op3_quality": op3_quality,
        "op4_decontamination": op4_decontamination,
        "op5_pii": op5_pii,
        "op6_packing": op6_packing,
        "op7_substrings": op7_substrings,
        "op8_sharding": op8_sharding,
        "op9_token_counts": op9_token_counts,
        "op10_html_extraction": op10_html_extraction,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_exact_topk": op12_exact_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": decontaminate.ORACLE_SQL, "op11_spelling_variants": spelling.ORACLE_SQL, "op12_exact_topk": topk.ORACLE_SQL}
