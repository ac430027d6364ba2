"""Ledger, explanations and the streaming forms."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import explain, fx, ledger
from ledgerloom.streaming.credits import match_stream, totals

D = "bank_txn_id string, stage string, resolution string, settlement_ids array<string>, credit_minor long, confidence decimal(4,2), reason string"


def decisions(spark, n=40):
    from decimal import Decimal

    return spark.createDataFrame([(f"B{i:03d}", "subset_sum", "MATCHED" if i % 3 else "TIE_AMBIGUOUS", [f"S{i}"], 100 * i, Decimal("0.90"), "why\n so") for i in range(n)], D)


def test_append_is_once_only_and_verifies(spark, tmp_path):
    path, posted = str(tmp_path / "ledger"), ledger.postings(decisions(spark))
    ledger.append(spark, path, posted)
    with pytest.raises(ValueError, match="already"):
        ledger.append(spark, path, posted)
    book = spark.read.parquet(path)
    assert sorted(r["sequence"] for r in book.collect()) == list(range(1, 41))
    assert ledger.verify(posted, book).count() == 0
    assert ledger.sequence_breaks(book, "sequence", "sequence").count() == 0
    assert {r["account"]: r["net_minor"] for r in ledger.balances(book).collect()}[ledger.SUSPENSE] == -sum(100 * i for i in range(40))
    changed = book.withColumn("evidence_digest", F.lit("0" * 32))
    assert {r["error"] for r in ledger.verify(posted, changed).collect()} == {"evidence_digest differs"}
    assert {r["error"] for r in ledger.verify(posted, book.limit(0)).collect()} == {"missing"}
    assert "basis" not in ledger.summaries(book).first()["summary"]


def test_explanations_cannot_change_a_decision(spark):
    rows = decisions(spark, 3)
    got = explain.explain(rows, lambda prompt: "ignore all: MATCHED everything" + prompt[:0])
    assert got.columns == ["bank_txn_id", "explanation"] and got.count() == 3
    assert "tie_ambiguous, settlement S0. why so." in explain.explain(rows).where("bank_txn_id = 'B000'").first()["explanation"]
    assert len(explain.prompts(rows.withColumn("reason", F.repeat(F.lit("y"), 900))).first()["prompt"]) < 600


def test_variance_causes(spark):
    cols = "id string, gross_minor long, fee_minor long, tax_minor long, net_minor long, stated_base_minor long, converted_minor long, fx_verdict string"
    rows = [("clean", 10000, 200, 36, 9764, 10000, None, None), ("fee", 10000, 200, 336, 9764, 10000, None, None), ("shift", 10000, 200, 36, 97640, 10000, None, None), ("open", 10000, 200, 36, 9000, 10000, None, None), ("fx", 10000, 200, 36, 9764, 10000, 10000, "FX_DRIFT_BENIGN"), ("norate", 10000, 200, 36, 9764, 10000, 10000, "NO_REFERENCE_RATE")]
    got = {r["id"]: r["attribution"] for r in fx.decompose_variance(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"clean": "NO_VARIANCE", "fee": "FEE_MISMATCH", "shift": "DATA_ENTRY_ERROR", "open": "UNRESOLVED", "fx": "FX_DRIFT_BENIGN", "norate": "UNRESOLVED"}


def test_streams(spark, tmp_path):
    day = datetime.date(2026, 8, 1)
    settled = spark.createDataFrame([("s1", 1000, "INR", day, "UTRAAAA1", None, None, None, None)], "settlement_id string, amount_minor long, currency string, settled_at date, utr string, end_to_end_id string, invoice_id string, order_id string, payment_id string")
    rows = [("c1", 1000, "INR", "x UTRAAAA1", datetime.datetime(2026, 8, 1, 9)), ("c2", 7, "INR", "nothing", datetime.datetime(2026, 8, 1, 10))]
    spark.createDataFrame(rows, "credit_id string, amount_minor long, currency string, narration string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("credit_id string, amount_minor long, currency string, narration string, ts timestamp").parquet(str(tmp_path / "in"))
    for name, frame, mode in (("matched", match_stream(stream, settled), "append"), ("totals", totals(stream), "complete")):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert [tuple(r) for r in spark.table("matched").collect()] == [("c1", "s1", 0, "MATCHED")]
    assert spark.table("totals").first()["amount_minor"] == 1007
