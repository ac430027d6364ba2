"""Reconciliation inputs derived from the driver's star schema, in Spark and, for the oracle, in SQL.

An order is a settlement, its line items are the settlement's rows, and each settlement has
one bank credit.  What the credit says and pays varies with the order key, so that every
branch of the operators occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import minor_of_double

#: Orders whose credit quotes no reference: one in so many.
SILENT = 101


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(prefix: str, key: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), width, "0"))


def _part(amount: Column, share: str) -> Column:
    return F.round(amount.cast("decimal(18,0)") * F.col(share).cast("decimal(4,2)"), 0).cast("long")


def settlement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").withColumn("amount_minor", minor_of_double(F.col("l_extendedprice")))
    return line.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", "refund").otherwise("payment").alias("type"),
        "amount_minor", _part(F.col("amount_minor"), "l_discount").alias("fee_minor"), _part(F.col("amount_minor"), "l_tax").alias("tax_minor"),
    )


def nets(rows: DataFrame) -> DataFrame:
    """(order_key, amount_minor): credit less fee and tax over payment rows; orders of refunds only have none."""
    pay = rows.where("type = 'payment'")
    return pay.groupBy("order_key").agg(F.sum(F.col("amount_minor") - F.col("fee_minor") - F.col("tax_minor")).alias("amount_minor"))


def settlements(spark: SparkSession, sf_dir: str, keep=None) -> DataFrame:
    """``keep(frame)`` holds what the rows are derived from, for queries that read them more than once."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("settled_at"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    joined = nets(settlement_rows(spark, sf_dir)).join(orders, "order_key").join(customer, "c_custkey")
    joined = keep(joined) if keep else joined
    none = F.lit(None).cast("string")
    return joined.select(
        "order_key", padded("S", F.col("order_key"), 10).alias("settlement_id"), "amount_minor", padded("C", F.col("c_nationkey"), 2).alias("currency"), "settled_at",
        padded("UTR", F.col("order_key"), 13).alias("utr"), none.alias("end_to_end_id"), padded("INV-", F.col("order_key"), 8).alias("invoice_id"), none.alias("order_id"), none.alias("payment_id"),
        F.col("c_name").alias("settlement_name"),
    )


def credits(settled: DataFrame) -> DataFrame:
    k, silent = F.col("order_key") % 7, F.col("order_key") % SILENT == 0
    amount = F.col("amount_minor") + F.when(silent, 0).when(k == 1, 50).when(k == 2, -5000).when(k == 3, 5000).otherwise(0)
    narration = (
        F.when(silent, "NEFT CR PAYOUT BATCH").when(k == 4, F.concat(F.lit("payout "), F.lower("invoice_id")))
        .when(k == 6, F.concat(F.lit("NEFT-"), F.col("utr"), F.lit("-REF "), padded("INV-", F.col("order_key") + 7, 8))).otherwise(F.concat(F.lit("NEFT CR "), F.col("utr")))
    )
    day = F.date_add("settled_at", (F.col("order_key") % 5).cast("int"))
    return settled.select(
        "order_key", padded("B", F.col("order_key"), 10).alias("credit_id"), amount.alias("amount_minor"), F.when((k == 5) & ~silent, "XXX").otherwise(F.col("currency")).alias("currency"),
        day.alias("value_date"), day.alias("booking_date"), narration.alias("narration"), F.col("settlement_name").alias("credit_name"),
    )


def silent(credit: DataFrame) -> DataFrame:
    """The credits that no reference can resolve: what the reference stage passes on."""
    return credit.where("narration = 'NEFT CR PAYOUT BATCH'")


def truth(settled: DataFrame) -> DataFrame:
    k, quiet = F.col("order_key") % 7, F.col("order_key") % SILENT == 0
    link = F.when(quiet, "MATCHED").when(k == 2, "PARTIAL").when(k.isin(3, 5), None).otherwise("MATCHED")
    return settled.select(padded("B", F.col("order_key"), 10).alias("bank_txn_id"), F.when(quiet, "silent").otherwise(F.concat(F.lit("class_"), k.cast("string"))).alias("defect_class"), F.array("settlement_id").alias("true_ids"), link.alias("true_resolution"))


ROWS_SQL = """rows_ AS (
    SELECT *, CAST(round(CAST(amount_minor AS DECIMAL(18,0)) * CAST(l_discount AS DECIMAL(4,2)), 0) AS BIGINT) AS fee_minor,
           CAST(round(CAST(amount_minor AS DECIMAL(18,0)) * CAST(l_tax AS DECIMAL(4,2)), 0) AS BIGINT) AS tax_minor
    FROM (SELECT l_orderkey AS order_key, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 'refund' ELSE 'payment' END AS type,
                 CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS amount_minor, l_discount, l_tax FROM lineitem))"""
SETTLEMENTS_SQL = ROWS_SQL + """,
settlements AS (
    SELECT n.order_key, 'S' || lpad(CAST(n.order_key AS VARCHAR), 10, '0') AS settlement_id, amount_minor, 'C' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS currency,
           CAST(o_orderdate AS DATE) AS settled_at, 'UTR' || lpad(CAST(n.order_key AS VARCHAR), 13, '0') AS utr, 'INV-' || lpad(CAST(n.order_key AS VARCHAR), 8, '0') AS invoice_id, c_name AS settlement_name
    FROM (SELECT order_key, CAST(sum(amount_minor - fee_minor - tax_minor) AS BIGINT) AS amount_minor FROM rows_ WHERE type = 'payment' GROUP BY order_key) n
    JOIN orders ON o_orderkey = n.order_key JOIN customer ON c_custkey = o_custkey)"""
CREDITS_SQL = SETTLEMENTS_SQL + f""",
credits AS (
    SELECT order_key, 'B' || lpad(CAST(order_key AS VARCHAR), 10, '0') AS credit_id, order_key % 7 AS k, order_key % {SILENT} = 0 AS quiet,
           amount_minor + CASE WHEN order_key % {SILENT} = 0 THEN 0 WHEN order_key % 7 = 1 THEN 50 WHEN order_key % 7 = 2 THEN -5000 WHEN order_key % 7 = 3 THEN 5000 ELSE 0 END AS amount_minor,
           CASE WHEN order_key % 7 = 5 AND order_key % {SILENT} <> 0 THEN 'XXX' ELSE currency END AS currency, settled_at + CAST(order_key % 5 AS INTEGER) AS value_date,
           CASE WHEN order_key % {SILENT} = 0 THEN 'NEFT CR PAYOUT BATCH' WHEN order_key % 7 = 4 THEN 'payout ' || lower(invoice_id)
                WHEN order_key % 7 = 6 THEN 'NEFT-' || utr || '-REF INV-' || lpad(CAST(order_key + 7 AS VARCHAR), 8, '0') ELSE 'NEFT CR ' || utr END AS narration,
           settlement_name AS credit_name
    FROM settlements),
truth AS (
    SELECT credit_id AS bank_txn_id, CASE WHEN quiet THEN 'silent' ELSE 'class_' || k END AS defect_class, ['S' || lpad(CAST(order_key AS VARCHAR), 10, '0')] AS true_ids,
           CASE WHEN quiet THEN 'MATCHED' WHEN k = 2 THEN 'PARTIAL' WHEN k IN (3, 5) THEN NULL ELSE 'MATCHED' END AS true_resolution FROM credits)"""
TOKENS_SQL = CREDITS_SQL + """,
tokens AS (
    SELECT DISTINCT credit_id, upper(array_to_string(list_slice(parts, i, i + n - 1), '-')) AS value
    FROM (SELECT credit_id, string_split(unnest(regexp_extract_all(narration, '[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*')), '-') AS parts FROM credits),
         unnest(range(1, len(parts) + 1)) AS a(i), unnest(range(1, least(3, len(parts) - i + 1) + 1)) AS b(n)
    WHERE length(array_to_string(list_slice(parts, i, i + n - 1), '-')) >= 6),
refs AS (
    SELECT value, min(rank) AS rank, min(field) AS field, min(settlement_id) AS settlement_id
    FROM (SELECT upper(utr) AS value, 0 AS rank, 'utr' AS field, settlement_id FROM settlements UNION ALL SELECT upper(invoice_id), 2, 'invoice_id', settlement_id FROM settlements)
    WHERE length(value) >= 6 GROUP BY value HAVING count(*) = 1)"""
STAGE1_SQL = TOKENS_SQL + """,
hits AS (SELECT credit_id, list_sort(list(DISTINCT settlement_id)) AS settlement_ids, min(struct_pack(rank := rank, field := field, sid := settlement_id)) AS best FROM tokens JOIN refs USING (value) GROUP BY credit_id),
paired AS (
    SELECT c.credit_id, h.settlement_ids, best.field AS field, c.amount_minor AS credit_minor, s.amount_minor AS net, s.amount_minor - c.amount_minor AS gap, len(h.settlement_ids) > 1 AS many, c.currency = s.currency AS same,
           CASE best.field WHEN 'utr' THEN 0.99 WHEN 'invoice_id' THEN 0.97 END AS trust
    FROM hits h JOIN credits c USING (credit_id) JOIN settlements s ON s.settlement_id = best.sid),
stage1 AS (
    SELECT credit_id AS bank_txn_id, CASE WHEN many THEN 'AMBIGUOUS' WHEN NOT same THEN 'UNMATCHED' WHEN abs(gap) <= 100 THEN 'MATCHED' WHEN gap > 0 THEN 'PARTIAL' ELSE 'UNMATCHED' END AS resolution,
           settlement_ids, field, credit_minor, CASE WHEN NOT many THEN net END AS net_minor, CASE WHEN NOT many THEN gap END AS residual_minor,
           CAST(CASE WHEN many THEN 0.30 WHEN NOT same THEN 0.10 WHEN abs(gap) <= 100 THEN trust - CASE WHEN gap <> 0 THEN 0.04 ELSE 0 END WHEN gap > 0 THEN trust - 0.10 ELSE 0.20 END AS DECIMAL(4,2)) AS confidence,
           CASE WHEN many THEN 'narration names several settlements' WHEN NOT same THEN 'currencies differ' WHEN abs(gap) <= 100 THEN 'reference and amount agree'
                WHEN gap > 0 THEN 'credit covers the settlement in part' ELSE 'credit exceeds the settlement' END AS reason
    FROM paired)"""
CLASSIFIED_SQL = STAGE1_SQL + """,
classified AS (
    SELECT *, CASE WHEN NOT asserted AND NOT linked THEN 'correct' WHEN NOT asserted AND got = 'TIE_AMBIGUOUS' THEN 'tie_ambiguous' WHEN NOT asserted THEN 'false_clear'
                   WHEN NOT linked THEN 'false_match' WHEN list_sort(got_ids) = list_sort(true_ids) AND got = true_resolution THEN 'correct' ELSE 'false_match' END AS verdict
    FROM (SELECT t.*, s.resolution AS got, s.settlement_ids AS got_ids, s.confidence, coalesce(s.resolution IN ('MATCHED', 'PARTIAL'), false) AS asserted, coalesce(true_resolution IN ('MATCHED', 'PARTIAL'), false) AS linked
          FROM truth t LEFT JOIN stage1 s USING (bank_txn_id)))"""
