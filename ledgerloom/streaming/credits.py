"""A stream of bank credits: reference matching as they come, daily totals with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import references
from ..operators.reference_match import FIELDS, TOLERANCE, reference_index


def match_stream(credits: DataFrame, settlements: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(bank_txn_id, settlement_id, residual_minor, resolution) of credits as they arrive.

    ``settlements`` is static; its index of discriminating references is joined to the
    stream, so the stream keeps no state.  A credit that names two settlements gives two rows.
    """
    own = [F.col(c) for c in FIELDS if c in credits.columns]
    index = reference_index(settlements).join(settlements.select("settlement_id", F.col("amount_minor").alias("net_minor"), F.col("currency").alias("net_currency")), "settlement_id")
    tokens = credits.withColumn("value", F.explode(references(F.col("narration"), *own)))
    residual = F.col("net_minor") - F.col("amount_minor")
    kind = F.when(F.col("currency") != F.col("net_currency"), "UNMATCHED").when(F.abs(residual) <= tolerance, "MATCHED").when(residual > 0, "PARTIAL").otherwise("UNMATCHED")
    return tokens.join(index, "value").select(F.col("credit_id").alias("bank_txn_id"), "settlement_id", residual.alias("residual_minor"), kind.alias("resolution"))


def totals(credits: DataFrame, late: str = "7 days", width: str = "1 day") -> DataFrame:
    """(window, currency, credits, amount_minor) by event time ``ts``; rows later than ``late`` are dropped by the watermark."""
    return credits.withWatermark("ts", late).groupBy(F.window("ts", width), "currency").agg(F.count("*").alias("credits"), F.sum("amount_minor").alias("amount_minor"))
