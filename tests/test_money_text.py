"""Money, tokens and similarity."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import money, text


def test_parse_minor(spark):
    rows = [("12.50", 1250), (" 7 ", 700), ("-0.5", -50), ("+3", 300), (".25", 25), ("1.234", None), ("12,50", None), ("", None), ("abc", None), ("1e3", None), ("NaN", None), (None, None)]
    frame = spark.createDataFrame(rows, "raw string, want long").withColumn("got", money.parse_minor(F.col("raw")))
    assert [r["got"] for r in frame.collect()] == [w for _, w in rows]


def test_rate_keeps_eight_decimals_and_refuses_nine(spark):
    got = spark.createDataFrame([("83.12345678",), ("83.123456789",)], "raw string").select(money.parse_rate(F.col("raw")).alias("r")).collect()
    assert str(got[0]["r"]) == "83.12345678" and got[1]["r"] is None


def test_float_money_is_refused_before_running(spark):
    with pytest.raises(money.FloatMoneyError):
        money.forbid_float_money(spark.createDataFrame([(1.5,)], "amount double"), "amount")


def test_strict_raises(spark):
    frame = spark.createDataFrame([("x",)], "raw string")
    with pytest.raises(Exception, match="not understood"):
        frame.select(money.strict(money.parse_minor(F.col("raw")), F.col("raw"), "amount")).collect()


def test_rounding(spark):
    r = spark.range(1).select(money.half_up(F.lit("0.645").cast("decimal(9,3)"), 2).alias("u"), money.half_even(F.lit("0.645").cast("decimal(9,3)"), 2).alias("e")).first()
    assert (str(r["u"]), str(r["e"])) == ("0.65", "0.64")


def test_tokens(spark):
    got = spark.createDataFrame([("NEFT-ab12cd-REF x inv-2026-M00001",), ("",), (None,)], "n string").select(F.array_sort(text.narration_tokens(F.col("n"))).alias("t")).collect()
    assert got[0]["t"] == ["2026-M00001", "AB12CD", "AB12CD-REF", "INV-2026", "INV-2026-M00001", "M00001", "NEFT-AB12CD", "NEFT-AB12CD-REF"]
    assert got[1]["t"] == [] and got[2]["t"] == []


@pytest.mark.parametrize(("a", "b", "want"), [("MARTHA", "MARHTA", 0.961111), ("DWAYNE", "DUANE", 0.84), ("", "X", 0.0), ("SAME", "SAME", 1.0), ("MUELLER INDUSTRIES GMBH", "MULLER INDUSTRIES GMBH", None)])
def test_jaro_winkler(a, b, want):
    import duckdb

    if want is None:
        want = duckdb.sql(f"select jaro_winkler_similarity('{a}', '{b}')").fetchall()[0][0]
    assert text.jaro_winkler_pairs([a], [b])[0] == pytest.approx(want, abs=1e-5)
