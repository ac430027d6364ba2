"""Writers of the feeds, by Spark's own file writers, so that any store will do."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bank import CAMT_NAMESPACE


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``; on a single machine without one, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def minor_text(minor: Column, point: str = ".") -> Column:
    """Minor units as text of two decimals."""
    size = F.abs(minor)
    return F.concat(F.when(minor < 0, "-").otherwise(""), F.floor(size / 100).cast("string"), F.lit(point), F.lpad((size % 100).cast("string"), 2, "0"))


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.csv(path, header=True)


def _column(frame: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in frame.columns else F.lit(None).cast(kind)


def rate_text(rate: Column) -> Column:
    """A rate as text without trailing zeros."""
    return F.regexp_replace(rate.cast("decimal(18,8)").cast("string"), r"\.?0+$", "")


def write_camt(credits: DataFrame, path: str) -> None:
    """A camt.053 document per partition: (record_id, counterparty_name, narration, amount_minor, currency, booking_date, value_date, end_to_end_id).

    Where the credits have them, foreign_amount_minor with foreign_currency and
    conversion_rate are written as instructed amount and exchange rate.
    """
    day = lambda c: F.struct(F.date_format(c, "yyyy-MM-dd").alias("Dt"))
    abroad, money, rate = _column(credits, "foreign_amount_minor", "long"), _column(credits, "foreign_currency", "string"), _column(credits, "conversion_rate", "decimal(18,8)")
    instructed = F.when(abroad.isNotNull(), F.struct(F.struct(minor_text(abroad).alias("_VALUE"), money.alias("_Ccy")).alias("Amt")))
    exchange = F.when(rate.isNotNull(), F.struct(F.struct(rate_text(rate).alias("XchgRate")).alias("CcyXchg")))
    amounts = F.when(abroad.isNotNull() | rate.isNotNull(), F.struct(instructed.alias("InstdAmt"), exchange.alias("TxAmt")))
    details = F.struct(
        F.struct(F.col("end_to_end_id").alias("EndToEndId")).alias("Refs"), amounts.alias("AmtDtls"), F.struct(F.struct(F.col("counterparty_name").alias("Nm")).alias("Dbtr")).alias("RltdPties"),
        F.struct(F.col("narration").alias("Ustrd")).alias("RmtInf"),
    )
    rows = credits.select(
        F.col("record_id").alias("NtryRef"), F.struct(minor_text(F.col("amount_minor")).alias("_VALUE"), F.col("currency").alias("_Ccy")).alias("Amt"), F.lit("CRDT").alias("CdtDbtInd"),
        day("booking_date").alias("BookgDt"), day("value_date").alias("ValDt"), F.struct(details.alias("TxDtls")).alias("NtryDtls"),
    )
    rows.write.format("xml").option("rootTag", f'Document xmlns="{CAMT_NAMESPACE}"').option("rowTag", "Ntry").save(path)


def write_mt103(credits: DataFrame, path: str) -> None:
    """MT103 messages: (end_to_end_id, amount_minor, currency, value_date, counterparty_name, narration), remittance at 35 characters a line, four lines.

    Where the credits have them, foreign_amount_minor with foreign_currency, conversion_rate
    and purpose_code are written as :33B:, :36: and :72:.
    """
    lines = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.substring(F.col("narration"), i * 35 + 1, F.lit(35)))
    field = lambda tag, text: F.coalesce(F.concat(F.lit(f"\n:{tag}:"), text), F.lit(""))
    abroad = F.concat(_column(credits, "foreign_currency", "string"), minor_text(_column(credits, "foreign_amount_minor", "long"), ","))
    rate = rate_text(_column(credits, "conversion_rate", "decimal(18,8)"))
    text = F.concat(
        F.lit("{1:F01}{2:O103}{4:\n:20:"), F.col("end_to_end_id"), F.lit("\n:32A:"), F.date_format("value_date", "yyMMdd"), F.col("currency"), minor_text(F.col("amount_minor"), ","),
        field("33B", abroad), field("36", F.when(rate.contains("."), F.regexp_replace(rate, r"\.", ",")).otherwise(F.concat(rate, F.lit(",")))), F.lit("\n:50K:"), F.col("counterparty_name"),
        F.lit("\n:70:"), F.array_join(F.filter(lines, lambda x: x != ""), "\n"), F.lit("\n:71A:SHA"),
        field("72", F.concat(F.lit("/ACC/PURPOSE CODE "), _column(credits, "purpose_code", "string"))), F.lit("\n-}\n$"),
    )
    credits.select(text.alias("value")).write.text(path)


def write_report(report: dict, path: str, inputs: tuple[str, ...] = ()) -> None:
    """A report as JSON with sorted keys and as Markdown beside it; never below an input folder."""
    full = os.path.abspath(path)
    if any(os.path.commonpath([full, os.path.abspath(i)]) == os.path.abspath(i) for i in inputs):
        raise ValueError(f"a report must not be written below its inputs: {path}")
    with open(f"{path}.json", "w", encoding="utf-8") as out:
        json.dump(report, out, indent=2, sort_keys=True, default=str)
    with open(f"{path}.md", "w", encoding="utf-8") as out:
        out.write(render_markdown(report))


def render_markdown(report: dict) -> str:
    """A section per key; lists of rows become tables."""
    out = []
    for title, value in sorted(report.items()):
        out.append(f"## {title}\n")
        if isinstance(value, list) and value and isinstance(value[0], dict):
            names = list(value[0])
            out += ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(str(r.get(n)) for n in names) + " |" for r in value)]
        else:
            out.append(str(value))
        out.append("")
    return "\n".join(out)
