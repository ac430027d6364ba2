"""Seeded books of settlements, invoices, rates, bank credits and truth, at any size.

Everything is computed from hashes of the seed and a case's number, so a book is the same
at every run and on any cluster, and no row depends on another task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cases of each class in a hundred or so.
MAIN = {"clean_match": 70, "subset_sum_bundle": 8, "fx_drift_benign": 6, "fx_drift_flagged": 4, "missing_remitter": 4, "partial_payment": 3, "refund_fx_asymmetry": 2, "timing_pending": 2, "edpms_open": 1}
HOLDOUT = {"clean_match": 35, "subset_sum_bundle": 15, "fx_drift_benign": 10, "fx_drift_flagged": 10, "missing_remitter": 12, "partial_payment": 7, "refund_fx_asymmetry": 5, "timing_pending": 4, "edpms_open": 2}
STRESS = {"ocr_noise": 1, "transliteration": 1, "invoice_description": 1, "abbreviation": 1, "legal_vs_trading": 1}
ABROAD = ("fx_drift_benign", "fx_drift_flagged", "refund_fx_asymmetry", "edpms_open")
FIRST = "Amber Borealis Cobalt Dorado Ember Falcon Garnet Harbour Indigo Juniper Kestrel Lumen Meridian Nimbus Orchid Pioneer Quartz Rüdiger Sølvik Tamarind".split()
SECOND = "Agro Builders Cargo Dyes Electronics Foods Glass Hardware Imports Jewels Kitchens Logistics Metals Naturals Optics Paper Rubber Systems Textiles Wires".split()
THIRD = ("Industries Private Limited", "International GmbH", "Trading Company", "Manufacturing Corporation", "Brothers and Sons")
#: What abbreviations and readers of scans make of names.
SHORT = {"International": "Intl", "Private Limited": "Pvt Ltd", "Corporation": "Corp", "Company": "Co", "Industries": "Inds", "Manufacturing": "Mfg"}
DAYS, START = 180, "2026-01-05"


class Dice:
    """Numbers that follow from a seed, a case and a name."""

    def __init__(self, seed: int, *keys: Column):
        self.seed, self.keys = seed, keys

    def below(self, n: int, name: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), *self.keys, F.lit(name)), F.lit(n))

    def text(self, name: str, size: int) -> Column:
        return F.substring(F.sha2(F.concat_ws("|", F.lit(str(self.seed)), *[k.cast("string") for k in self.keys], F.lit(name)).cast("binary"), 256), 1, size)

    def one_of(self, values, name: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (self.below(len(values), name) + 1).cast("int"))


def _class(dice: Dice, mix: dict[str, int]) -> Column:
    draw, total, out = dice.below(sum(mix.values()), "class"), 0, F.lit(None).cast("string")
    for name, weight in mix.items():
        total += weight
        out = F.when(out.isNull() & (draw < total), name).otherwise(out)
    return out


def _share(amount: Column, percent: Column) -> Column:
    return F.round(amount.cast("decimal(20,4)") * percent, 0).cast("long")


def rates(spark: SparkSession, seed: int) -> DataFrame:
    """(value_date, currency_pair, source, reference_rate) for each day and foreign currency."""
    days = spark.range(DAYS + 60).select(F.col("id").alias("day"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(r).alias("r")) for c, r in (("USD", 83), ("EUR", 90), ("GBP", 105))])).alias("x"))
    rate = (F.col("x.r") + Dice(seed, F.col("day"), F.col("x.c")).below(10_000, "rate").cast("decimal(10,0)") * F.lit("0.0001").cast("decimal(10,4)")).cast("decimal(18,8)")
    return days.select(F.date_add(F.lit(START).cast("date"), F.col("day").cast("int")).alias("value_date"), F.concat_ws("/", "x.c", F.lit("INR")).alias("currency_pair"), F.lit("REFERENCE").alias("source"), rate.alias("reference_rate"))


def _name(dice: Dice) -> Column:
    return F.concat_ws(" ", dice.one_of(FIRST, "first"), dice.one_of(SECOND, "second"), dice.one_of(THIRD, "third"))


def _told_name(name: Column, kind: Column, dice: Dice) -> Column:
    """The name as the bank tells it."""
    short = name
    for long, brief in SHORT.items():
        short = F.regexp_replace(short, long, brief)
    plain = F.regexp_replace(F.regexp_replace(name, "ü", "ue"), "ø", "oe")
    return (
        F.when(kind == "ocr_noise", F.translate(name, "OISl", "0151")).when(kind == "transliteration", plain).when(kind == "abbreviation", short)
        .when(kind == "legal_vs_trading", F.concat(F.lit("Holding "), dice.text("legal", 8))).when(kind == "missing_remitter", F.lit("")).otherwise(name)
    )


def book(spark: SparkSession, cases: int, seed: int, mix: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """A book of ``cases`` cases: frames ``settlement_rows``, ``invoices``, ``rates``, ``credits``, ``truth`` and ``decoys``.

    The first two have the columns that the readers of the feeds give.  Bundles are of two to
    four settlements; their decoys are as many settlements of the cases that follow.  A
    ``timing_pending`` case has no credit.  In stress cases the credit quotes no reference and
    is some tenths of a percent off, so that only the name can tell.
    """
    mix = mix or MAIN
    number = F.col("id")
    dice = Dice(seed, number)
    base = spark.range(cases).select(number, _class(dice, mix).alias("defect_class"), F.date_add(F.lit(START).cast("date"), dice.below(DAYS, "day").cast("int")).alias("settled_at"), _name(dice).alias("customer_name"))
    kind = F.col("defect_class")
    members = F.when(kind == "subset_sum_bundle", dice.below(3, "members") + 2).otherwise(1).cast("int")
    lines = base.withColumn("member", F.explode(F.sequence(F.lit(1), members)))
    own = Dice(seed, number, F.col("member"))
    abroad = kind.isin(*ABROAD)
    money = F.when(abroad, own.one_of(("USD", "EUR", "GBP"), "currency")).otherwise("INR")
    lines = lines.select("*", F.concat(F.lit("setl_"), own.text("settlement", 14)).alias("settlement_id"), F.upper(own.text("utr", 16)).alias("settlement_utr"), F.concat(F.lit("pay_"), own.text("payment", 14)).alias("entity_id"),
                         F.concat(F.lit("order_"), own.text("order", 14)).alias("order_id"), F.format_string("INV-2026-%08d", number * 10 + F.col("member")).alias("order_receipt"), abroad.alias("international"), money.alias("currency"), (own.below(4_000_000, "amount") + 100_000).alias("amount_minor"))
    known = lines.join(F.broadcast(rates(spark, seed).select(F.col("value_date").alias("settled_at"), F.substring("currency_pair", 1, 3).alias("currency"), "reference_rate")), ["settled_at", "currency"], "left")  # 720 rows
    drift = F.when(kind == "fx_drift_flagged", 120 + own.below(200, "drift")).otherwise(own.below(80, "drift") - 40).cast("decimal(10,0)") * F.lit("0.0001").cast("decimal(10,4)")
    known = known.withColumn("conversion_rate", F.when(abroad, F.round(F.col("reference_rate") * (1 + drift), 8).cast("decimal(18,8)")))
    known = known.withColumn("base_amount_minor", F.when(abroad, F.round(F.col("amount_minor").cast("decimal(20,0)") * F.col("conversion_rate"), 0).cast("long")).otherwise(F.col("amount_minor")))
    known = known.withColumn("fee_minor", _share(F.col("base_amount_minor"), F.when(abroad, F.lit("0.0300").cast("decimal(6,4)")).otherwise(F.lit("0.0200").cast("decimal(6,4)"))))
    known = known.withColumn("tax_minor", _share(F.col("fee_minor"), F.lit("0.1800").cast("decimal(6,4)")))
    known = known.withColumn("net_minor", F.col("base_amount_minor") - F.col("fee_minor") - F.col("tax_minor"))
    none = F.lit(None).cast("string")
    note = F.concat(F.lit("Payment for "), F.col("order_receipt"))
    common = {
        "position": F.struct(F.lit("book").alias("file"), F.lit(0).cast("long").alias("block"), (number * 10 + F.col("member")).alias("row")), "currency": F.col("currency"), "on_hold": F.lit(False), "settled": F.lit(True),
        "international": F.col("international"), "created_at": F.date_sub("settled_at", 2), "settled_at": F.col("settled_at"), "settlement_id": F.col("settlement_id"), "settlement_utr": F.col("settlement_utr"), "order_id": F.col("order_id"),
        "order_receipt": F.col("order_receipt"), "base_currency": F.lit("INR"), "description": note, "notes": F.col("order_receipt"), "method": F.lit("card"),
    }
    zero = F.lit(0).cast("long")
    payment = known.select(
        F.col("entity_id"), F.lit("payment").alias("type"), zero.alias("debit_minor"), F.col("net_minor").alias("credit_minor"), "amount_minor", "fee_minor", "tax_minor", "base_amount_minor", "conversion_rate",
        F.col("entity_id").alias("payment_id"), none.alias("refund_id"), *[c.alias(n) for n, c in common.items()],
    )
    back = known.where(kind == "refund_fx_asymmetry")
    value = F.round(F.col("amount_minor").cast("decimal(20,0)") * F.col("conversion_rate") * F.lit("1.0100").cast("decimal(6,4)"), 0).cast("long")
    refund = back.select(
        F.concat(F.lit("rfnd_"), own.text("refund", 14)).alias("entity_id"), F.lit("refund").alias("type"), value.alias("debit_minor"), zero.alias("credit_minor"), "amount_minor", zero.alias("fee_minor"), zero.alias("tax_minor"), value.alias("base_amount_minor"),
        "conversion_rate", F.col("entity_id").alias("payment_id"), F.concat(F.lit("rfnd_"), own.text("refund", 14)).alias("refund_id"), *[c.alias(n) for n, c in common.items()],
    )
    shipped = F.when(F.col("international"), F.upper(own.text("bill", 7)))
    invoices = known.select(
        common["position"].alias("position"), F.col("order_receipt").alias("invoice_id"), F.date_sub("settled_at", 5).alias("invoice_date"), "order_id", "customer_name", F.lit("IN").alias("customer_country"), "currency", F.col("amount_minor").alias("invoice_minor"),
        F.lit("PAID").alias("invoice_status"), F.when(F.col("international"), "P0802").alias("purpose_code"), shipped.alias("shipping_bill_no"), F.when(F.col("international"), F.date_sub("settled_at", 4)).alias("shipping_bill_date"),
        F.when(F.col("international"), F.date_add("settled_at", 270)).alias("realisation_deadline"), F.when(kind == "edpms_open", F.floor(F.col("amount_minor") / 2)).otherwise(F.col("amount_minor")).cast("long").alias("realised_minor"),
        F.when(kind == "invoice_description", F.concat(F.lit("Consignment of "), F.lower("customer_name"))).alias("notes"),
    )
    per = known.groupBy("id").agg(F.sum("net_minor").alias("net_minor"), F.array_sort(F.collect_list("settlement_id")).alias("true_ids"), F.min("settlement_utr").alias("utr"), F.min("order_receipt").alias("receipt"))
    paid = base.join(per, "id").where(kind != "timing_pending").withColumn("bank_txn_id", F.format_string("BANK%010d", number))
    stress = kind.isin(*STRESS)
    off = F.round(F.col("net_minor") * (dice.below(7, "off") + 2) / 1000, 0).cast("long")
    amount = F.when(kind == "partial_payment", F.floor(F.col("net_minor") * 3 / 5)).when(stress, F.col("net_minor") - off).otherwise(F.col("net_minor")).cast("long")
    said = (
        F.when(kind == "subset_sum_bundle", "BULK PAYOUT").when(kind == "missing_remitter", "CREDIT").when(kind == "invoice_description", F.concat(F.lit("PAYMENT FOR CONSIGNMENT OF "), F.upper("customer_name")))
        .when(stress, "INWARD REMITTANCE").when(dice.below(2, "quote") == 0, F.concat(F.lit("NEFT CR-"), F.col("utr"), F.lit("-RAZOR"))).otherwise(F.concat(F.lit("settlement "), F.lower("receipt")))
    )
    day = F.date_add("settled_at", dice.below(3, "later").cast("int"))
    credits = paid.select(
        F.col("bank_txn_id").alias("record_id"), _told_name(F.col("customer_name"), kind, dice).alias("counterparty_name"), said.alias("narration"), amount.alias("amount_minor"), F.lit("INR").alias("currency"), day.alias("booking_date"), day.alias("value_date"),
        none.alias("end_to_end_id"), number.alias("position"),
    )
    truth = paid.select("bank_txn_id", "defect_class", "true_ids", F.when(kind == "partial_payment", "PARTIAL").otherwise("MATCHED").alias("true_resolution"))
    # a bundle's decoys: the settlements of as many cases that follow, by number
    wanted = known.where(kind == "subset_sum_bundle").select(F.col("id").alias("bundle"), F.pmod(number + F.col("member"), F.lit(max(1, cases))).alias("id"))
    taken = wanted.join(known.where("member = 1").select("id", "settlement_id"), "id")
    decoys = taken.groupBy("bundle").agg(F.array_sort(F.collect_set("settlement_id")).alias("decoy_ids")).select(F.format_string("BANK%010d", F.col("bundle")).alias("bank_txn_id"), "decoy_ids")
    return {"settlement_rows": payment.unionByName(refund), "invoices": invoices, "rates": rates(spark, seed), "credits": credits, "truth": truth, "decoys": decoys}


def strangers(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Credits that no settlement covers: other payers, other money, dates after the book, or amounts below any settlement."""
    dice = Dice(seed, F.col("id"))
    why = dice.below(3, "why")
    day = F.date_add(F.lit(START).cast("date"), F.when(why == 0, DAYS + 200).otherwise(dice.below(DAYS, "day")).cast("int"))
    return spark.range(n).select(
        F.format_string("ODD%010d", "id").alias("record_id"), F.concat(F.lit("STRANGER "), F.upper(dice.text("name", 6))).alias("counterparty_name"), F.concat(F.lit("REF "), F.upper(dice.text("ref", 10))).alias("narration"),
        F.when(why == 2, dice.below(40_000, "amount") + 1_000).otherwise(dice.below(4_000_000, "amount") + 100_000).alias("amount_minor"), F.when(why == 1, "USD").otherwise("INR").alias("currency"), day.alias("booking_date"), day.alias("value_date"),
        F.lit(None).cast("string").alias("end_to_end_id"), (F.lit(1 << 40) + F.col("id")).alias("position"),
    )
