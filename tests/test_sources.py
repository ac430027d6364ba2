"""Readers and writers on small files of our own."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import receivables
from ledgerloom.sources import bank, csv_feeds, writers

DAY = datetime.date(2026, 8, 5)
HEAD = ",".join(csv_feeds.SETTLEMENT_COLUMNS)
PAY = "pay_1,payment,0.00,97.00,100.00,INR,2.00,0.36,N,Y,2026-08-01,2026-08-03,setl_1,UTR0000000000001,Payment for INV-1,INV-1,pay_1,order_1,INV-1,upi,N,,100.00,INR,"
REFUND = PAY.replace("pay_1,payment,0.00,97.00", "rfnd_1,refund,50.00,0.00")


def test_settlements_net_payments_only(spark, tmp_path):
    (tmp_path / "s.csv").write_text("\n".join([HEAD, PAY, REFUND]) + "\n")
    row = csv_feeds.settlements_of(csv_feeds.read_settlement_rows(spark, str(tmp_path / "s.csv"))).first()
    assert (row["record_id"], row["amount_minor"], row["utr"], row["settled_at"]) == ("setl_1", 9700, "UTR0000000000001", datetime.date(2026, 8, 3))


def test_settlement_without_payment_raises(spark, tmp_path):
    (tmp_path / "s.csv").write_text("\n".join([HEAD, REFUND]) + "\n")
    with pytest.raises(Exception, match="without a payment row"):
        csv_feeds.settlements_of(csv_feeds.read_settlement_rows(spark, str(tmp_path / "s.csv"))).collect()


def test_strict_and_permissive_money(spark, tmp_path):
    (tmp_path / "s.csv").write_text("\n".join([HEAD, PAY.replace("97.00", "97.001")]) + "\n")
    path = str(tmp_path / "s.csv")
    assert csv_feeds.read_settlement_rows(spark, path, "permissive").first()["credit_minor"] is None
    with pytest.raises(Exception, match="not understood"):
        csv_feeds.read_settlement_rows(spark, path).collect()


def test_last_rate_wins(spark, tmp_path):
    (tmp_path / "r.csv").write_text("value_date,currency_pair,source,reference_rate\n2026-08-01,USD/INR,A,83.1\n2026-08-01,USD/INR,B,84.2\n")
    rows = csv_feeds.read_rates(spark, str(tmp_path / "r.csv")).collect()
    assert [(r["source"], float(r["reference_rate"])) for r in rows] == [("B", 84.2)]


def credits(spark):
    rows = [("B1", "ACME LTD", "NEFT UTR123456789 " + "x" * 40, 123456, "INR", DAY, DAY, "FT1"), ("B2", "Ünal & Co", "pay <2>", 5, "INR", DAY, DAY, "FT2")]
    return spark.createDataFrame(rows, "record_id string, counterparty_name string, narration string, amount_minor long, currency string, booking_date date, value_date date, end_to_end_id string")


def test_camt_round_trip(spark, tmp_path):
    writers.write_camt(credits(spark), str(tmp_path / "camt"))
    got = bank.read_camt(spark, str(tmp_path / "camt"))
    assert sorted(map(tuple, got.select(*credits(spark).columns).collect())) == sorted(map(tuple, credits(spark).collect()))


def test_camt_wrong_namespace_and_debit(spark, tmp_path):
    entry = "<Ntry><NtryRef>R</NtryRef><Amt Ccy='INR'>1.00</Amt><CdtDbtInd>{}</CdtDbtInd></Ntry>"
    text = "<?xml version='1.0'?><Document xmlns='{}'><BkToCstmrStmt><Stmt>{}</Stmt></BkToCstmrStmt></Document>"
    (tmp_path / "a.xml").write_text(text.format("urn:other", entry.format("CRDT")))
    with pytest.raises(bank.StatementError):
        bank.read_camt(spark, str(tmp_path / "a.xml"))
    (tmp_path / "b.xml").write_text(text.format(bank.CAMT_NAMESPACE, entry.format("DBIT")))
    assert bank.read_camt(spark, str(tmp_path / "b.xml")).count() == 0
    (tmp_path / "c.xml").write_text(text.format(bank.CAMT_NAMESPACE, entry.format("CRDT").replace("<NtryRef>R</NtryRef>", "")))
    with pytest.raises(Exception, match="NtryRef is missing"):
        bank.read_camt(spark, str(tmp_path / "c.xml")).collect()


def test_mt103_round_trip_rejoins_wrapped_text(spark, tmp_path):
    writers.write_mt103(credits(spark), str(tmp_path / "mt"))
    got = {r["end_to_end_id"]: r for r in bank.read_mt103(spark, str(tmp_path / "mt")).collect()}
    assert got["FT1"]["narration"] == "NEFT UTR123456789 " + "x" * 40
    assert (got["FT1"]["amount_minor"], got["FT2"]["amount_minor"], got["FT1"]["value_date"]) == (123456, 5, DAY)


@pytest.mark.parametrize(("message", "why"), [("no block here", "block 4"), ("{4:\n:20:X\n:50K:N\n-}", "32A"), ("{4:\n:32A:260805INR1,00\n:50K:N\n-}", ":20:"), ("{4:\n:20:X\n:32A:260805INR1,00\n-}", ":50a:")])
def test_mt103_malformed(spark, message, why):
    with pytest.raises(Exception, match=why):
        bank.parse_mt103(spark.createDataFrame([(message,)], "message string")).collect()


def test_mt103_departures(spark):
    """Repeated tags, a wrapped :72:, an account after blanks, a trailer at a line's end, malformed fields."""
    head = "{1:F01}{4:\n:20:R1\n"
    one = head + ":32A:260805INR1234,5\n:33B:USD15,25\n:36:81,5\n:50K:  /ACC1\n ACME LTD \n\n1 ROAD\n:59:/BEN9\nUS\n:70:first half \n:70:second\nhalf\n:72:/ACC/PURPOSE CO\nDE P08\n02-}"
    row = bank.parse_mt103(spark.createDataFrame([(one,)], "message string")).first()
    assert (row["narration"], row["purpose_code"], row["counterparty_name"], row["ordering_account"]) == ("first half secondhalf", "P0802", "ACME LTD 1 ROAD", "ACC1")
    assert (row["amount_minor"], row["foreign_amount_minor"], row["foreign_currency"], float(row["conversion_rate"]), row["beneficiary"], row["beneficiary_account"]) == (123450, 1525, "USD", 81.5, "US", "BEN9")
    for bad, why in ((":32A:260805INR1,00X", "32A"), (":32A:261305INR1,00", "32A"), (":32A:260805INR1,005", "32A"), (":32A:260805INR1,00\n:33B:US1,00", "33B"), (":32A:260805INR1,00\n:36:abc", "36")):
        with pytest.raises(Exception, match=why):
            bank.parse_mt103(spark.createDataFrame([(f"{head}{bad}\n:50K:N\n-}}",)], "message string")).collect()


def test_foreign_legs_round_trip(spark, tmp_path):
    rows = credits(spark).withColumns({"foreign_amount_minor": F.when(F.col("record_id") == "B1", F.lit(1500)).cast("long"), "foreign_currency": F.when(F.col("record_id") == "B1", "USD"), "conversion_rate": F.when(F.col("record_id") == "B1", F.lit("82.5")).cast("decimal(18,8)"), "purpose_code": F.when(F.col("record_id") == "B1", "P0802")})
    names = ["end_to_end_id", "amount_minor", "foreign_amount_minor", "foreign_currency", "conversion_rate"]
    want = sorted(map(str, rows.select(*names).collect()))
    writers.write_camt(rows, str(tmp_path / "camt"))
    writers.write_mt103(rows, str(tmp_path / "mt"))
    assert sorted(map(str, bank.read_camt(spark, str(tmp_path / "camt")).select(*names).collect())) == want
    wires = bank.read_mt103(spark, str(tmp_path / "mt"))
    assert sorted(map(str, wires.select(*names).collect())) == want
    assert {r["purpose_code"] for r in wires.collect()} == {"P0802", None}


def test_truth_and_invoices(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"cases": [{"case_id": "k1", "defect_class": "clean", "expected_link": {"bank_txn_id": "b1", "covers_settlement_ids": ["s2", "s1"]}, "expected_link_resolution": "MATCHED"}, {"case_id": "k2", "defect_class": "timing_pending", "expected_link": {"bank_txn_id": null}}]}')
    got = {r["case_id"]: r.asDict() for r in bank.read_truth(spark, str(tmp_path / "t.json")).collect()}
    assert got["k1"] == {"case_id": "k1", "defect_class": "clean", "bank_txn_id": "b1", "settlement_ids": ["s1", "s2"], "link_resolution": "MATCHED"}
    assert got["k2"]["bank_txn_id"] is None and got["k2"]["settlement_ids"] == []
    lines = [",".join(csv_feeds.INVOICE_COLUMNS), "INV-1,2026-08-01,order_1,Acme Ltd,US,USD,100.50,OPEN,P0802,SB1,2026-08-02,2027-05-01,,note", "INV-2,2026-08-01,,Bolt,US,USD,7.00,PAID,,,,,7.00,"]
    (tmp_path / "i.csv").write_text("\n".join(lines) + "\n")
    rows = {r["invoice_id"]: r for r in csv_feeds.read_invoices(spark, str(tmp_path / "i.csv")).collect()}
    assert (rows["INV-1"]["invoice_minor"], rows["INV-1"]["realised_minor"], rows["INV-1"]["shipping_bill_no"], rows["INV-2"]["order_id"]) == (10050, 0, "SB1", None)
    aged = receivables.age_receipts(csv_feeds.read_invoices(spark, str(tmp_path / "i.csv")), F.lit(DAY))
    assert [(r["invoice_id"], r["outstanding_minor"], r["status"]) for r in aged.collect()] == [("INV-1", 10050, "AGING")]


def test_reports_stay_out_of_inputs(tmp_path):
    with pytest.raises(ValueError, match="below its inputs"):
        writers.write_report({}, str(tmp_path / "data" / "r"), (str(tmp_path / "data"),))
    writers.write_report({"rows": [{"a": 1}]}, str(tmp_path / "r"))
    assert "| a |" in (tmp_path / "r.md").read_text()


def test_receivable_statuses(spark):
    rows = [("a", 100, 100, DAY, "sb"), ("b", 100, 40, DAY, "sb"), ("c", 100, 0, DAY, "sb"), ("d", 100, 0, DAY - datetime.timedelta(days=9), "sb"), ("e", 100, 0, DAY, None), ("f", 100, None, None, "sb")]
    frame = spark.createDataFrame(rows, "invoice_id string, invoice_minor long, realised_minor long, realisation_deadline date, shipping_bill_no string")
    aged = receivables.age_receipts(frame, F.lit(DAY))
    assert {r["invoice_id"]: r["status"] for r in aged.collect()} == {"a": "REALISED", "b": "OPEN_EDPMS_LINKAGE", "c": "AGING", "d": "OPEN_EDPMS_LINKAGE", "f": "AGING"}
    assert [r["invoice_id"] for r in receivables.open_exceptions(aged).collect()] == ["d", "b"]
