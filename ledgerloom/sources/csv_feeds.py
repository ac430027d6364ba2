"""Comma-separated feeds: settlement export, invoice ledger, reference rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import parse_minor, parse_rate, strict

# The columns of the exports, in their order.
SETTLEMENT_COLUMNS = (
    "entity_id type debit credit amount currency fee tax on_hold settled created_at settled_at settlement_id settlement_utr "
    "description notes payment_id order_id order_receipt method international conversion_rate base_amount base_currency refund_id"
).split()
INVOICE_COLUMNS = (
    "invoice_id invoice_date order_id customer_name customer_country currency invoice_amount invoice_status purpose_code "
    "shipping_bill_no shipping_bill_date realisation_deadline realised_amount notes"
).split()
RATE_COLUMNS = "value_date currency_pair source reference_rate".split()


def _read(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False).select("*", order.alias("position"))


def _date(c: str) -> Column:
    return F.to_date(F.nullif(F.trim(c), F.lit("")))


def _text(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _yes(c: str) -> Column:
    return F.upper(F.trim(c)) == "Y"


def _money(c: str, mode: str) -> Column:
    value = parse_minor(F.col(c))
    return strict(value, F.col(c), c) if mode == "strict" else value


def read_settlement_rows(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """The export's rows, typed.  ``strict`` raises on money it can't read, ``permissive`` gives null."""
    raw = _read(spark, path, SETTLEMENT_COLUMNS)
    return raw.select(
        "position", "entity_id", "type", *[_money(c, mode).alias(f"{c}_minor") for c in ("debit", "credit", "amount", "fee", "tax", "base_amount")],
        "currency", *[_yes(c).alias(c) for c in ("on_hold", "settled", "international")], *[_date(c).alias(c) for c in ("created_at", "settled_at")],
        "settlement_id", *[_text(c).alias(c) for c in ("settlement_utr", "payment_id", "order_id", "order_receipt", "base_currency", "refund_id")],
        "description", "notes", "method", parse_rate(F.col("conversion_rate")).alias("conversion_rate"),
    )


def settlements_of(rows: DataFrame) -> DataFrame:
    """One canonical settlement per ``settlement_id``.

    The net is credit less debit over payment rows; refunds are never netted in.  Other
    fields come from the first payment row.  A settlement without a payment row raises.
    """
    pay = F.col("type") == "payment"
    first = F.min(F.when(pay, F.struct("position", "created_at", "settled_at", "settlement_utr", "description", "payment_id", "order_id", "order_receipt", "base_currency", "conversion_rate", "base_amount_minor", "international", "amount_minor", "currency", "method")))
    grouped = rows.groupBy("settlement_id").agg(F.sum(F.when(pay, F.col("credit_minor") - F.col("debit_minor"))).alias("amount_minor"), first.alias("f"), F.min("position").alias("position"))
    checked = F.when(F.col("f").isNull(), F.raise_error(F.concat(F.lit("settlement without a payment row: "), F.col("settlement_id"))).cast("bigint")).otherwise(F.col("amount_minor"))
    abroad = F.col("f.international")
    return grouped.select(
        F.lit("settlement").alias("source"), F.col("settlement_id").alias("record_id"), F.lit("").alias("counterparty_name"), F.coalesce("f.description", F.lit("")).alias("narration"),
        checked.alias("amount_minor"), F.coalesce("f.base_currency", F.lit("INR")).alias("currency"), F.col("f.created_at").alias("created_at"), F.col("f.settled_at").alias("settled_at"),
        F.col("f.settlement_utr").alias("utr"), F.lit(None).cast("string").alias("end_to_end_id"), F.col("f.order_receipt").alias("invoice_id"), F.col("f.order_id").alias("order_id"),
        F.col("f.payment_id").alias("payment_id"), F.col("f.conversion_rate").alias("conversion_rate"), F.when(abroad, F.col("f.amount_minor")).alias("foreign_amount_minor"),
        F.when(abroad, F.col("f.currency")).alias("foreign_currency"), F.col("f.base_amount_minor").alias("base_amount_minor"), F.col("f.method").alias("channel"), "position",
    )


def read_invoices(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    raw = _read(spark, path, INVOICE_COLUMNS)
    return raw.select(
        "position", "invoice_id", _date("invoice_date").alias("invoice_date"), _text("order_id").alias("order_id"), "customer_name", "customer_country", "currency",
        _money("invoice_amount", mode).alias("invoice_minor"), "invoice_status", _text("purpose_code").alias("purpose_code"), _text("shipping_bill_no").alias("shipping_bill_no"),
        _date("shipping_bill_date").alias("shipping_bill_date"), _date("realisation_deadline").alias("realisation_deadline"),
        F.coalesce(_money("realised_amount", mode), F.lit(0)).alias("realised_minor"), "notes",
    )


def export_receipts(invoices: DataFrame) -> DataFrame:
    """The invoices that were shipped abroad, for :func:`..operators.receivables.age_receipts`."""
    return invoices.where(F.col("shipping_bill_no").isNotNull()).select("invoice_id", "invoice_minor", "realised_minor", "realisation_deadline", "shipping_bill_no", "shipping_bill_date", "currency", "purpose_code")


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """(value_date, currency_pair, source, reference_rate): of repeated keys the last row counts."""
    raw = _read(spark, path, RATE_COLUMNS).select("position", _date("value_date").alias("value_date"), F.trim("currency_pair").alias("currency_pair"), "source", parse_rate(F.col("reference_rate")).alias("reference_rate"))
    last = raw.groupBy("value_date", "currency_pair").agg(F.max(F.struct("position", "source", "reference_rate")).alias("r"))
    return last.select("value_date", "currency_pair", "r.source", "r.reference_rate")
