"""An append-only, double-entry ledger of decisions.

Spark cannot refuse a write the way a ledger server does: :func:`append` refuses
identifiers that are there already, and :func:`verify` finds what was changed later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.digest import basis_points, digest128

# Accounts and stage codes.
SUSPENSE, RECONCILED, EXCEPTIONS = 1, 2, 3
STAGES = {"deterministic": 1, "subset_sum": 2, "probabilistic": 3, "fuzzy": 4}
UNKNOWN_STAGE = 999


def _evidence(decisions: DataFrame) -> Column:
    """The evidence of each decision as one text: ``name=value`` in the order of the names."""
    if "evidence" not in decisions.columns:
        return F.lit("")
    pairs = F.array_sort(F.map_entries("evidence"))
    return F.coalesce(F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "|"), F.lit(""))


def postings(decisions: DataFrame) -> DataFrame:
    """One transfer per decision (bank_txn_id, stage, resolution, settlement_ids, credit_minor, confidence, reason).

    ``evidence``, a map of names to values, is part of the evidence's digest where the
    decisions have it.
    """
    code = F.lit(UNKNOWN_STAGE)
    for name, n in STAGES.items():
        code = F.when(F.col("stage") == name, n).otherwise(code)
    ids = F.array_join(F.array_sort("settlement_ids"), ",")
    return decisions.select(
        digest128(F.col("bank_txn_id"), F.col("stage"), F.col("resolution"), ids).alias("transfer_id"), "bank_txn_id", F.lit(SUSPENSE).alias("debit_account"),
        F.when(F.col("resolution").isin("MATCHED", "PARTIAL"), RECONCILED).otherwise(EXCEPTIONS).alias("credit_account"), F.col("credit_minor").alias("amount_minor"), code.alias("stage_code"),
        basis_points(F.col("confidence")).alias("confidence_bp"),
        digest128(F.col("stage"), F.col("resolution"), F.col("reason"), F.format_string("%.4f", F.col("confidence").cast("double")), ids, _evidence(decisions)).alias("evidence_digest"),
        F.substring(digest128(ids), 1, 16).alias("settlements_digest"),
    )


def balances(ledger: DataFrame) -> DataFrame:
    """(account, debits_minor, credits_minor, net_minor) of each account."""
    sides = F.explode(F.array(F.struct(F.col("debit_account").alias("account"), F.col("amount_minor").alias("debit"), F.lit(0).cast("long").alias("credit")), F.struct(F.col("credit_account").alias("account"), F.lit(0).cast("long").alias("debit"), F.col("amount_minor").alias("credit")))).alias("s")
    return ledger.select(sides).select("s.*").groupBy("account").agg(F.sum("debit").alias("debits_minor"), F.sum("credit").alias("credits_minor"), (F.sum("credit") - F.sum("debit")).alias("net_minor"))


def sequenced(transfers: DataFrame, after: int = 0, keep=None) -> DataFrame:
    """Transfers with a strictly increasing ``sequence`` by id, without one task for all: offsets per range partition.

    The ranges come from a sample and may be merged by size, so a second evaluation may cut
    them elsewhere: ``keep(frame)`` writes them before their sizes are taken (default: a
    reliable checkpoint).
    """
    keep = keep or (lambda frame: frame.checkpoint(eager=True))
    ranged = keep(transfers.repartitionByRange("transfer_id").sortWithinPartitions("transfer_id").withColumn("part", F.spark_partition_id()))
    ranged = ranged.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("transfer_id")))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(before), "part").withColumn("sequence", F.col("at") + F.col("before") + after).drop("part", "at", "before")  # a row per partition


def append(spark: SparkSession, path: str, transfers: DataFrame) -> int:
    """Append to the ledger at ``path``; nothing is written if an id repeats or is there already."""
    again = transfers.groupBy("transfer_id").count().where("count > 1").take(1)
    try:
        old = spark.read.parquet(path)
        last = old.agg(F.max("sequence")).first()[0] or 0
        again = again or transfers.join(old, "transfer_id", "left_semi").take(1)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        last = 0
    if again:
        raise ValueError(f"the ledger has this transfer already: {again[0]['transfer_id']}")
    sequenced(transfers, last).write.mode("append").parquet(path)
    return last


def verify(expected: DataFrame, ledger: DataFrame) -> DataFrame:
    """(transfer_id, error) for each decision that the ledger lacks or holds otherwise."""
    fields = ("debit_account", "credit_account", "amount_minor", "stage_code", "confidence_bp", "evidence_digest", "settlements_digest")
    held = ledger.select("transfer_id", *[F.col(c).alias(f"held_{c}") for c in fields], F.lit(True).alias("there"))
    joined = expected.join(held, "transfer_id", "left")
    error = F.when(F.col("there").isNull(), "missing")
    for c in fields:
        error = error.when(~F.col(c).eqNullSafe(F.col(f"held_{c}")), f"{c} differs")
    return joined.select("transfer_id", error.alias("error")).where(F.col("error").isNotNull())


def lookup(ledger: DataFrame, bank_txn_id: str) -> DataFrame:
    """The transfers of one credit, in the order they were written."""
    return ledger.where(F.col("bank_txn_id") == bank_txn_id).orderBy("sequence")


def verify_log(expected: DataFrame, ledger: DataFrame) -> DataFrame:
    """(transfer_id, error) of all that is wrong with a ledger; none if it is sound.

    Decisions that are missing or held otherwise, sequence numbers that repeat or are
    missing, and books that don't balance: what leaves the suspense account must be what
    the two others get.
    """
    repeated = ledger.groupBy("sequence").agg(F.count("*").alias("n"), F.min("transfer_id").alias("transfer_id")).where("n > 1 or sequence is null")
    repeated = repeated.select("transfer_id", F.lit("sequence repeats").alias("error"))
    suspense, known = F.col("debit_account") == SUSPENSE, F.col("credit_account").isin(RECONCILED, EXCEPTIONS)
    amount = lambda side: F.coalesce(F.sum(F.when(side, F.col("amount_minor"))), F.lit(0))
    books = ledger.agg(amount(suspense).alias("out"), amount(known).alias("in"), F.max("sequence").alias("last"), F.count("*").alias("n"))
    unbalanced = books.where("out <> in").select(F.lit(None).cast("string").alias("transfer_id"), F.format_string("out of balance: %d left suspense, %d arrived", "out", "in").alias("error"))
    gaps = books.where("last <> n").select(F.lit(None).cast("string").alias("transfer_id"), F.format_string("%d transfers, the last is number %d", "n", "last").alias("error"))
    return verify(expected, ledger).unionByName(repeated).unionByName(unbalanced).unionByName(gaps)


def sequence_breaks(ledger: DataFrame, order: str = "event_id", value: str = "sequence", group: str | None = None) -> DataFrame:
    """Rows whose value does not exceed that of the row before, within each group."""
    before = F.lag(value).over(Window.partitionBy(*([group] if group else [])).orderBy(order))
    return ledger.withColumn("previous", before).where(F.col(value) <= F.col("previous"))


def summaries(ledger: DataFrame) -> DataFrame:
    return ledger.select("transfer_id", F.format_string("%s: %d minor units to account %d, stage %d, confidence %d bp", "bank_txn_id", "amount_minor", "credit_account", "stage_code", "confidence_bp").alias("summary"))
