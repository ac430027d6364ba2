"""Stage 1: a credit whose references name exactly one settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MIN_REFERENCE, references

TOLERANCE = 100
# How far a match on each field is trusted.
STRENGTH = {"utr": "0.99", "end_to_end_id": "0.99", "invoice_id": "0.97", "order_id": "0.95", "payment_id": "0.95"}
FIELDS = tuple(STRENGTH)


def _strength(field: Column) -> Column:
    out = F.lit(None).cast("decimal(4,2)")
    for name, value in STRENGTH.items():
        out = F.when(field == name, F.lit(value).cast("decimal(4,2)")).otherwise(out)
    return out


def reference_index(settlements: DataFrame) -> DataFrame:
    """(value, field, settlement_id) of the reference values that one entry alone has."""
    entries = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(f).alias("field"), F.upper(F.col(f)).alias("value")) for i, f in enumerate(FIELDS)])
    rows = settlements.select("settlement_id", F.explode(entries).alias("e")).select("settlement_id", "e.*").where(F.length("value") >= MIN_REFERENCE)
    one = rows.groupBy("value").agg(F.count("*").alias("n"), F.min(F.struct("rank", "field", "settlement_id")).alias("e")).where("n = 1")
    return one.select("value", "e.rank", "e.field", "e.settlement_id")


def match_by_reference(credits: DataFrame, settlements: DataFrame, tolerance: int = TOLERANCE, keep=None) -> DataFrame:
    """A result for each credit whose references hit the index; other credits give no row.

    Of several fields that name the settlement the strongest counts, so the confidence does
    not depend on any order.  Columns: bank_txn_id, resolution, settlement_ids, field,
    credit_minor, net_minor, residual_minor, confidence, reason.  With ``keep``, which
    writes a frame and reads it again, Spark may split the join with the index at a token
    that stands in very many narrations.
    """
    own = [F.col(c) for c in FIELDS if c in credits.columns]
    tokens = credits.select("credit_id", F.explode(references(F.col("narration"), *own)).alias("value"))
    index = reference_index(settlements)
    hits = tokens.join(keep(index) if keep else index, "value")
    per = hits.groupBy("credit_id").agg(F.array_sort(F.collect_set("settlement_id")).alias("settlement_ids"), F.min(F.struct("rank", "field", "settlement_id")).alias("best"))
    net = settlements.select(F.col("settlement_id").alias("sid"), F.col("amount_minor").alias("net_minor"), F.col("currency").alias("net_currency"))
    joined = per.select("credit_id", "settlement_ids", "best.field", F.col("best.settlement_id").alias("sid")).join(net, "sid").join(credits.select("credit_id", F.col("amount_minor").alias("credit_minor"), "currency"), "credit_id")
    many, residual = F.size("settlement_ids") > 1, F.col("net_minor") - F.col("credit_minor")
    same, close = F.col("currency").eqNullSafe(F.col("net_currency")), F.abs(residual) <= tolerance
    trust = _strength(F.col("field"))
    kind = F.when(many, "AMBIGUOUS").when(~same, "UNMATCHED").when(close, "MATCHED").when(residual > 0, "PARTIAL").otherwise("UNMATCHED")
    dec = lambda x: F.lit(x).cast("decimal(4,2)")
    confidence = F.when(many, dec("0.30")).when(~same, dec("0.10")).when(close, trust - F.when(residual != 0, dec("0.04")).otherwise(dec("0.00"))).when(residual > 0, trust - dec("0.10")).otherwise(dec("0.20"))
    reason = F.when(many, "narration names several settlements").when(~same, "currencies differ").when(close, "reference and amount agree").when(residual > 0, "credit covers the settlement in part").otherwise("credit exceeds the settlement")
    return joined.select(
        F.col("credit_id").alias("bank_txn_id"), kind.alias("resolution"), "settlement_ids", "field", "credit_minor", F.when(~many, F.col("net_minor")).alias("net_minor"),
        F.when(~many, residual).alias("residual_minor"), confidence.cast("decimal(4,2)").alias("confidence"), reason.alias("reason"),
    )
