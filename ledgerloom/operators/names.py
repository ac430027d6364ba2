"""From parsed feeds to the inputs of the matcher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _last(invoices: DataFrame, key: str, to: str) -> DataFrame:
    """One invoice a key: of several the one that stands last."""
    known = invoices.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return known.groupBy(F.col(key).alias(to)).agg(F.max_by(F.struct("customer_name", "notes"), "position").alias(f"by_{to}"))


def name_settlements(settlements: DataFrame, invoices: DataFrame) -> DataFrame:
    """``settlements`` with settlement_name and invoice_notes, through the invoice id or, where no invoice has that, the order id.

    An invoice that is found by its id counts even if its name is empty; an empty name is null.
    """
    joined = settlements.join(_last(invoices, "invoice_id", "invoice_id"), "invoice_id", "left").join(_last(invoices, "order_id", "order_id"), "order_id", "left")
    found = F.coalesce("by_invoice_id", "by_order_id")
    blank = lambda c: F.nullif(c, F.lit(""))
    return joined.withColumns({"settlement_name": blank(found["customer_name"]), "invoice_notes": blank(found["notes"])}).drop("by_invoice_id", "by_order_id")


def matcher_settlements(records: DataFrame, invoices: DataFrame) -> DataFrame:
    """Canonical settlements, as :func:`..sources.csv_feeds.settlements_of` gives them, for :func:`..plans.reconcile.reconcile`."""
    named = name_settlements(records, invoices)
    text = F.concat_ws(" ", "settlement_name", F.nullif(F.col("narration"), F.lit("")), "invoice_notes")
    return named.select(
        F.col("record_id").alias("settlement_id"), "amount_minor", "currency", "settled_at", "utr", "end_to_end_id", "invoice_id", "order_id", "payment_id", "settlement_name", text.alias("settlement_text"), "position",
    )


def matcher_credits(records: DataFrame, position: Column | None = None) -> DataFrame:
    """Canonical credits, as the statement readers give them, for :func:`..plans.reconcile.reconcile`; ``position``: their place in the input."""
    names = [F.col("record_id").alias("credit_id"), "amount_minor", "currency", "value_date", "booking_date", "narration", F.col("counterparty_name").alias("credit_name"), "end_to_end_id"]
    return records.select(*names, *([] if position is None else [position.alias("position")]))
