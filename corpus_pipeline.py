"""From raw documents to packed training sequences, stage by stage.

Each stage works on all rows that its predecessor kept and takes effect at once; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, minhash, packing, substrings, toxicity
from ledgerloom.llm.common import give_back_memory, id_bucket, scratch_path, table

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below ``TOXIC_FROM``.

    Null and empty texts score as a text without words; repeated rows stay or go together;
    an empty table stays empty, and without labels nothing goes.
    """
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(*toxicity.sample_labelled(docs, labels, id_bucket(labels["doc_id"], 4) != 2))
    give_back_memory()
    return toxicity.drop_toxic(docs, model, TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate class.

    Null and empty texts all stay, but for rows repeated under one id; ties and repeated
    rows leave one row; a null id stays only where its class has no other.
    """
    return minhash.drop_near_duplicates(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur twice or more; ``n_chars`` follows the text.

    Null texts stay null; a text of such passages only becomes empty and its row stays.
    """
    out = substrings.remove_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; null and empty texts, and rows under an empty benchmark, all stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of at most 4096 tokens.

    A null or empty text is its end id alone; repeated rows are packed each.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained scorer and a tokenizer are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
