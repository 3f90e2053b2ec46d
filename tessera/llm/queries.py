"""The ten operators applied to their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, dedup, html, jpeg, langid, lm, packing, pii, simhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", _sha256("base").alias("base_sha256"), "spans")


def op2_pack_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER))


def op3_simhash_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op5_exact_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.ExactDedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).report()


def op6_bpe_two_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    return both.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    chats = chat.format_chats(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))
    back = chats.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("spans")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        _sha256("loss").alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_media_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = jpeg.store_and_load(_table(spark, sf_dir, "documents"))
    feature = F.concat_ws(";", F.array_join("shape", "x"), F.array_join("mean_milli", ","), F.lower(F.hex(F.crc32("rgb"))))
    return m.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op9_langid_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op10_lm_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_semicrf,
        op2_pack_best_two_fit,
        op3_simhash_bitsliced,
        op4_html_templates,
        op5_exact_dedup_stream,
        op6_bpe_two_tier,
        op7_chat_round_trip,
        op8_media_progressive_jpeg,
        op9_langid_bitmask,
        op10_lm_log_bilinear,
    )
}

ORACLES = {"op5_exact_dedup_stream": dedup.ORACLE, "op7_chat_round_trip": chat.ORACLE}
