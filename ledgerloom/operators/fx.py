"""FX and fee checks of settlements: applied rates, variance, refunds and timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND_BPS = 65
TAX_SHARE = "0.18"
CLOSE = 1  # minor units
SHIFTS = (-3, -2, -1, 1, 2, 3)
TIMING_DAYS = 7
# The attributions, all of them always reported.
ATTRIBUTIONS = ("NO_VARIANCE", "FX_DRIFT_BENIGN", "FX_DRIFT_FLAGGED", "FEE_MISMATCH", "DATA_ENTRY_ERROR", "UNRESOLVED")


def deviation_bps(applied: Column, reference: Column) -> Column:
    """Deviation in basis points, two decimals half up; exact decimals throughout."""
    ref = F.when(reference != 0, reference.cast("decimal(18,8)"))
    return F.round(((applied.cast("decimal(18,8)") - ref).cast("decimal(20,8)") * 10000).cast("decimal(26,8)") / ref, 2).cast("decimal(18,2)")


def rate_verdict(bps: Column, band: int = BAND_BPS) -> Column:
    return F.when(bps.isNull(), "NO_REFERENCE_RATE").when(F.abs(bps) <= band, "FX_DRIFT_BENIGN").otherwise("FX_DRIFT_FLAGGED")


def check_rates(rows: DataFrame, rates: DataFrame, band: int = BAND_BPS) -> DataFrame:
    """International rows with reference_rate, deviation_bps and verdict.

    ``rows``: currency, base_currency, settled_at, conversion_rate.  The reference rate is
    that of the very day; no rate is carried forward, and a missing or zero one is refused.
    """
    pair = F.concat_ws("/", F.col("currency"), F.coalesce("base_currency", F.lit("INR")))
    abroad = rows.where(F.col("conversion_rate").isNotNull() & (F.col("currency") != F.coalesce("base_currency", F.lit("INR"))))
    ref = rates.select(F.col("value_date").alias("settled_at"), F.col("currency_pair").alias("pair"), "reference_rate")
    joined = abroad.withColumn("pair", pair).join(ref, ["settled_at", "pair"], "left")
    return joined.withColumn("deviation_bps", deviation_bps(F.col("conversion_rate"), F.col("reference_rate"))).withColumn("verdict", rate_verdict(F.col("deviation_bps"), band))


def decimal_shift(expected: Column, actual: Column) -> Column:
    """The power of ten, -3 to 3, that turns the expected amount into the actual one; else null."""
    out = F.lit(None).cast("int")
    for k in reversed(SHIFTS):
        hit = expected * 10**k == actual if k > 0 else expected == actual * 10**-k
        out = F.when(hit & (expected != 0), k).otherwise(out)
    return out


def is_transposition(expected: Column, actual: Column) -> Column:
    """Whether the two amounts are different orders of the same digits."""
    digits = lambda c: F.array_sort(F.split(c.cast("string"), ""))
    return (expected >= 0) & (actual >= 0) & (expected != actual) & ((expected - actual) % 9 == 0) & (digits(expected) == digits(actual))


def explains(residual: Column, correction: Column, close: int = CLOSE) -> Column:
    return (correction != 0) & (F.abs(residual - correction) <= close)


def settlement_sums(rows: DataFrame, key: str = "settlement_id") -> DataFrame:
    """(key, gross_minor, fee_minor, tax_minor, refund_minor) over a settlement's rows.

    Gross and refunds are in the base currency where a row has that, else as stated;
    fees and taxes are those of payments.  A settlement without payments has sums of 0.
    """
    base = F.coalesce("base_amount_minor", "amount_minor") if "base_amount_minor" in rows.columns else F.col("amount_minor")
    of = lambda kind, value: F.coalesce(F.sum(F.when((F.col("type") == "refund") == kind, value)), F.lit(0)).cast("long")
    return rows.groupBy(key).agg(of(False, base).alias("gross_minor"), of(False, F.col("fee_minor")).alias("fee_minor"), of(False, F.col("tax_minor")).alias("tax_minor"), of(True, base).alias("refund_minor"))


def decompose_variance(settlements: DataFrame, close: int = CLOSE) -> DataFrame:
    """Attribute what a settlement's net leaves unexplained to one cause.

    ``settlements``: gross_minor (at the applied rate), fee_minor, tax_minor, net_minor,
    stated_base_minor, converted_minor (foreign amount at the applied rate, null if
    domestic) and fx_verdict (null if domestic).  Adds expected_minor, residual_minor,
    candidates and attribution.  One candidate is the cause; none or several leave it open.
    """
    expected = F.col("gross_minor") - F.col("fee_minor") - F.col("tax_minor")
    residual = F.col("net_minor") - expected
    small = F.abs(residual) <= close
    fee_tax = F.round(F.col("fee_minor").cast("decimal(20,0)") * F.lit(TAX_SHARE).cast("decimal(4,2)"), 0).cast("long")
    fee = F.when(explains(residual, F.col("tax_minor") - fee_tax, close), "FEE_MISMATCH")
    off = F.col("converted_minor").isNotNull() & (F.abs(F.col("converted_minor") - F.col("stated_base_minor")) > close)
    typed = F.when(off & (decimal_shift(F.col("converted_minor"), F.col("stated_base_minor")).isNotNull() | is_transposition(F.col("converted_minor"), F.col("stated_base_minor"))), "DATA_ENTRY_ERROR")
    implied = F.when(off & typed.isNull() & explains(residual, F.col("stated_base_minor") - F.col("converted_minor"), close), F.col("fx_verdict"))
    net = F.when(decimal_shift(expected, F.col("net_minor")).isNotNull() | is_transposition(expected, F.col("net_minor")), "DATA_ENTRY_ERROR")
    found = F.array_distinct(F.array_compact(F.array(fee, typed, implied, net)))
    quiet = F.when(F.col("fx_verdict").isNull(), "NO_VARIANCE").when(F.col("fx_verdict") == "NO_REFERENCE_RATE", "UNRESOLVED").otherwise(F.col("fx_verdict"))
    none = F.expr("cast(array() as array<string>)")
    out = settlements.withColumns({"expected_minor": expected, "residual_minor": residual, "candidates": F.when(small, none).otherwise(found)})
    return out.withColumn("attribution", F.when(small, quiet).when(F.size("candidates") == 1, F.element_at(F.when(F.size("candidates") == 1, F.col("candidates")), 1)).otherwise("UNRESOLVED"))


def breakdown(decomposed: DataFrame) -> DataFrame:
    """(attribution, n): all six attributions, those that don't occur with 0."""
    every = decomposed.sparkSession.createDataFrame([(a,) for a in ATTRIBUTIONS], "attribution string")
    counts = decomposed.groupBy("attribution").agg(F.count("*").alias("n"))
    return every.join(counts, "attribution", "left").select("attribution", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def reconcile_refunds(rows: DataFrame) -> DataFrame:
    """Each refund row with its capture in the settlement: residuals in both currencies, and a finding.

    ``rows``: settlement_id, entity_id, payment_id, type, foreign_minor, base_minor.
    """
    capture = rows.where("type != 'refund'").select("settlement_id", F.col("entity_id").alias("payment_id"), F.col("foreign_minor").alias("capture_foreign_minor"), F.col("base_minor").alias("capture_base_minor"))
    refund = rows.where("type = 'refund'").select("settlement_id", "payment_id", F.col("entity_id").alias("refund_entity_id"), F.col("foreign_minor").alias("refund_foreign_minor"), F.col("base_minor").alias("refund_base_minor"))
    both = refund.join(capture, ["settlement_id", "payment_id"])
    foreign, base = F.col("refund_foreign_minor") - F.col("capture_foreign_minor"), F.col("refund_base_minor") - F.col("capture_base_minor")
    return both.withColumns({"foreign_residual_minor": foreign, "base_residual_minor": base, "finding": F.when(foreign == 0, "REFUND_FX_ASYMMETRY").otherwise("REFUND_AMOUNT_BREAK"), "expected_asymmetry": (foreign == 0) & (base != 0)})


def timing(settlements: DataFrame, as_of: Column, days: int = TIMING_DAYS) -> DataFrame:
    """Adds days_open and timing: pending up to ``days`` after settlement, also before it; overdue later or undated."""
    open_ = F.datediff(as_of, "settled_at")
    return settlements.withColumn("days_open", open_).withColumn("timing", F.when(open_ <= days, "TIMING_PENDING").otherwise("TIMING_OVERDUE"))


def band(deviations: DataFrame, column: str = "deviation_bps") -> DataFrame:
    """(n, rms, three_sigma, band_bps): root mean square about zero; three times it, rounded down to 5."""
    rms = F.sqrt(F.avg(F.col(column).cast("double") * F.col(column).cast("double")))
    return deviations.agg(F.count(column).alias("n"), F.round(rms, 4).alias("rms"), F.round(3 * rms, 4).alias("three_sigma"), (F.floor(3 * rms / 5) * 5).cast("long").alias("band_bps"))
