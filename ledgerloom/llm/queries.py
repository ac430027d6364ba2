"""The driver's queries: one for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embeddings, langid, minhash, packing, substrings, tokens, toxicity, warc
from .common import give_back_memory, id_bucket, scratch_path, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = id_bucket(docs["doc_id"], 5) == 0
    samples = langid.sample_texts(docs, ~held)
    found = langid.identify(docs, langid.fit(samples))
    return found.select("doc_id", (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(*toxicity.sample_labelled(docs, labels, id_bucket(labels["doc_id"], 4) != 2))
    give_back_memory()
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_captures(table(spark, sf_dir, "pages"), path, each=True)
    captures = warc.assemble(warc.read_records(spark, path, keep_payload=False))
    page = F.get_json_object("metadata.fields", "$.page-id").cast("long")
    rows = captures.select("capture_id", page.alias("page_id"), "response", F.col("refers_to").alias("earlier"))
    target = rows.select(F.col("capture_id").alias("target"), F.col("page_id").alias("target_page"))
    # responses meet themselves, so that no null key gathers them in one task
    rows = rows.withColumn("target", F.coalesce("earlier", "capture_id")).join(target, "target", "left")
    rows = rows.withColumn("refers_to", F.when(F.col("earlier").isNotNull(), F.col("target_page")))
    return rows.select("page_id", "response.payload_bytes", "response.payload_digest", F.col("response.warc_type").alias("record_type"), "refers_to")


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.format_preferences(chat.sibling_pairs(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return found.select("conv_id", "prompt_turns", "prompt", "chosen_text", spans("chosen_spans"), "rejected_text", spans("rejected_spans"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, names = substrings.find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.col(c) for c in names if c != "kept"])


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_warc": op4_warc,
    "op5_preferences": op5_preferences,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_packing": op9_packing,
    "op10_substring_dedup": op10_substring_dedup,
}
