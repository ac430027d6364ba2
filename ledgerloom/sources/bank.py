"""Bank statements: camt.053 XML and SWIFT MT103 text, as canonical credits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import parse_minor, parse_rate

# Fixed value: the namespace that a statement's root must have.
CAMT_NAMESPACE = "urn:iso:std:iso:20022:tech:xsd:camt.053.001.02"
CAMT_ENTRY = (
    "NtryRef STRING, Amt STRUCT<_VALUE: STRING, _Ccy: STRING>, CdtDbtInd STRING, BookgDt STRUCT<Dt: STRING>, ValDt STRUCT<Dt: STRING>, "
    "NtryDtls STRUCT<TxDtls: ARRAY<STRUCT<Refs: STRUCT<EndToEndId: STRING>, AmtDtls: STRUCT<InstdAmt: STRUCT<Amt: STRUCT<_VALUE: STRING, _Ccy: STRING>>, "
    "TxAmt: STRUCT<CcyXchg: STRUCT<XchgRate: STRING>>>, RltdPties: STRUCT<Dbtr: STRUCT<Nm: STRING>>, RmtInf: STRUCT<Ustrd: STRING>>>>"
)


class StatementError(ValueError):
    """A statement file is not what its format asks for."""


def check_camt_root(spark: SparkSession, path: str) -> None:
    """Raise unless each file's root is a Document of the expected namespace.

    Files are read tag by tag, so a large statement is never one value.
    """
    tags = spark.read.option("lineSep", ">").text(path)
    root = F.regexp_extract("value", r"<(?:\w+:)?Document\b([^>]*)$", 1)
    known = tags.where(root.contains(CAMT_NAMESPACE)).select(F.col("_metadata.file_path").alias("file")).distinct()
    bad = tags.select(F.col("_metadata.file_path").alias("file")).distinct().join(known, "file", "left_anti").take(1)
    if bad:
        raise StatementError(f"no camt.053.001.02 document: {bad[0][0]}")


def required(value: Column, what: str) -> Column:
    return F.when(value.isNull() | (F.trim(value) == ""), F.raise_error(F.lit(f"{what} is missing")).cast("string")).otherwise(F.trim(value))


def read_camt(spark: SparkSession, path: str) -> DataFrame:
    """Credits of the statements; debit entries are skipped, of several transaction details the first counts."""
    check_camt_root(spark, path)
    raw = spark.read.format("xml").option("rowTag", "Ntry").option("mode", "FAILFAST").schema(CAMT_ENTRY).load(path).where("CdtDbtInd = 'CRDT'")
    tx = F.col("NtryDtls.TxDtls").getItem(0)
    foreign = tx["AmtDtls"]["InstdAmt"]["Amt"]
    return raw.select(
        F.lit("bank_credit").alias("source"), required(F.col("NtryRef"), "NtryRef").alias("record_id"), F.coalesce(F.trim(tx["RltdPties"]["Dbtr"]["Nm"]), F.lit("")).alias("counterparty_name"),
        F.coalesce(tx["RmtInf"]["Ustrd"], F.lit("")).alias("narration"), parse_minor(required(F.col("Amt._VALUE"), "Amt")).alias("amount_minor"), F.col("Amt._Ccy").alias("currency"),
        F.to_date("BookgDt.Dt").alias("booking_date"), F.to_date("ValDt.Dt").alias("value_date"), tx["Refs"]["EndToEndId"].alias("end_to_end_id"),
        parse_rate(tx["AmtDtls"]["TxAmt"]["CcyXchg"]["XchgRate"]).alias("conversion_rate"), parse_minor(foreign["_VALUE"]).alias("foreign_amount_minor"), foreign["_Ccy"].alias("foreign_currency"),
    )


def mt103_messages(text: Column) -> Column:
    """The messages of a file, which stand between lines of a dollar sign."""
    return F.filter(F.split(F.regexp_replace(text, "\r\n", "\n"), r"\n\$\n?"), lambda m: F.trim(m) != "")


# How block 4, its tags and three of its fields are written.
_BLOCK4 = r"(?s)^.*?\{4:(.*)-\}\s*$"
_TAG = r"^:(\d{2}[A-Z]?):(.*)$"
_VALUE = r"^(\d{2})(\d{2})(\d{2})([A-Z]{3})([\d,]+)$"
_INSTRUCTED = r"^([A-Z]{3})([\d,]+)$"
_PURPOSE = r"PURPOSE CODE\s+(\S+)"
_FIELDS = "array<struct<tag:string,line:string>>"


def mt103_fields(message: Column) -> Column:
    """Array of (tag, line): the lines of block 4, those that open no tag under the tag before.

    Lines before the first tag and blank lines are left out.  Null without a block 4.
    """
    step = F.aggregate(
        F.split(F.regexp_extract(message, _BLOCK4, 1), "\n"),
        F.expr(f"cast(array() as {_FIELDS})"),
        lambda acc, line: F.when(line.rlike(_TAG), F.concat(acc, F.array(F.struct(F.regexp_extract(line, _TAG, 1).alias("tag"), F.regexp_extract(line, _TAG, 2).alias("line")))))
        .when((F.size(acc) == 0) | (F.trim(line) == ""), acc)
        .otherwise(F.concat(acc, F.array(F.struct(F.element_at(acc, -1)["tag"].alias("tag"), line.alias("line"))))),
    )
    return F.when(message.rlike(_BLOCK4), step)


def field_lines(fields: Column, *tags: str) -> Column:
    """All lines of the first of these tags that is there, repeated tags together; null without."""
    return F.coalesce(*[_lines_of(fields, tag) for tag in tags])


def _lines_of(fields: Column, tag: str) -> Column:
    lines = F.transform(F.filter(fields, lambda f: f["tag"] == tag), lambda f: f["line"])
    return F.when(F.size(lines) > 0, lines)


def _first_line(fields: Column, tag: str) -> Column:
    return F.trim(F.get(_lines_of(fields, tag), F.lit(0)))


def wrapped(lines: Column) -> Column:
    """Hard-wrapped text put together again, without separators."""
    return F.trim(F.array_join(lines, ""))


def _account_first(lines: Column) -> Column:
    return F.trim(F.element_at(lines, 1)).startswith("/")


def party(lines: Column) -> Column:
    """Name and address in one line; a leading account line is left out."""
    rest = F.when(_account_first(lines), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    return F.array_join(F.filter(F.transform(rest, lambda x: F.trim(x)), lambda x: x != ""), " ")


def account(lines: Column) -> Column:
    """The account of a party, without its slashes; null without one."""
    return F.when(_account_first(lines), F.nullif(F.regexp_replace(F.trim(F.element_at(lines, 1)), "^/+", ""), F.lit("")))


def _malformed(what: str, text: Column, kind: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"malformed field {what} "), text)).cast(kind)


def _amount(text: Column, what: str) -> Column:
    minor = parse_minor(F.regexp_replace(text, ",", "."))
    return F.when(text.isNotNull(), F.coalesce(minor, _malformed(what, text, "long")))


def parse_mt103(messages: DataFrame) -> DataFrame:
    """Credits from a frame with a ``message`` column.

    Block 4, :20:, :32A: and :50a: must be there; a malformed :32A:, :33B: or :36: raises.
    """
    f = F.col("fields")
    named = messages.withColumn("fields", mt103_fields(F.col("message"))).withColumn("fields", F.when(f.isNull(), F.raise_error(F.lit("MT103 without block 4")).cast(_FIELDS)).otherwise(f))
    value, instructed, rate = _first_line(f, "32A"), _first_line(f, "33B"), _first_line(f, "36")
    part = lambda k: F.regexp_extract(value, _VALUE, k)
    day = F.try_to_timestamp(F.concat(F.lit("20"), part(1), part(2), part(3)), F.lit("yyyyMMdd")).cast("date")
    checked = F.when(value.isNull(), F.raise_error(F.lit("MT103 without :32A:")).cast("date")).when(value.rlike(_VALUE) & day.isNotNull(), day).otherwise(_malformed(":32A:", value, "date"))
    payer = field_lines(f, "50K", "50A", "50F", "50")
    payer = F.when(payer.isNull(), F.raise_error(F.lit(":50a: is missing")).cast("array<string>")).otherwise(payer)
    foreign = F.when(instructed.isNotNull() & ~instructed.rlike(_INSTRUCTED), _malformed(":33B:", instructed, "string")).otherwise(instructed)
    return named.select(
        F.lit("bank_credit").alias("source"), required(_first_line(f, "20"), ":20:").alias("record_id"), party(payer).alias("counterparty_name"),
        F.coalesce(wrapped(field_lines(f, "70")), F.lit("")).alias("narration"), _amount(F.nullif(part(5), F.lit("")), ":32A:").alias("amount_minor"), F.nullif(part(4), F.lit("")).alias("currency"),
        checked.alias("booking_date"), checked.alias("value_date"), _first_line(f, "20").alias("end_to_end_id"),
        F.when(rate.isNotNull(), F.coalesce(parse_rate(F.regexp_replace(rate, ",", ".")), _malformed(":36:", rate, "decimal(18,8)"))).alias("conversion_rate"),
        _amount(F.regexp_extract(foreign, _INSTRUCTED, 2), ":33B:").alias("foreign_amount_minor"), F.regexp_extract(foreign, _INSTRUCTED, 1).alias("foreign_currency"),
        F.nullif(F.regexp_extract(wrapped(field_lines(f, "72")), _PURPOSE, 1), F.lit("")).alias("purpose_code"), F.coalesce(_first_line(f, "71A"), F.lit("")).alias("charges"),
        account(payer).alias("ordering_account"), account(field_lines(f, "59")).alias("beneficiary_account"), F.coalesce(party(field_lines(f, "59")), F.lit("")).alias("beneficiary"), F.lit("SWIFT_MT103").alias("channel"),
    )


def read_mt103(spark: SparkSession, path: str) -> DataFrame:
    return parse_mt103(spark.read.text(path, wholetext=True).select(F.explode(mt103_messages(F.col("value"))).alias("message")))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, defect_class, bank_txn_id, settlement_ids, link_resolution) of a truth file."""
    schema = "cases ARRAY<STRUCT<case_id: STRING, defect_class: STRING, expected_link: STRUCT<bank_txn_id: STRING, covers_settlement_ids: ARRAY<STRING>>, expected_link_resolution: STRING>>"
    case = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("cases").alias("c"))
    return case.select("c.case_id", "c.defect_class", F.col("c.expected_link.bank_txn_id").alias("bank_txn_id"), F.array_sort(F.coalesce("c.expected_link.covers_settlement_ids", F.array().cast("array<string>"))).alias("settlement_ids"), F.col("c.expected_link_resolution").alias("link_resolution"))
