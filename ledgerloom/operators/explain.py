"""Explanations of decisions; they never change one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze

FIELDS = ("bank_txn_id", "stage", "resolution", "confidence", "reason")


def prompts(decisions: DataFrame) -> DataFrame:
    """(bank_txn_id, verdict_json, prompt): the decision as strings, and a one-line request to explain it."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in FIELDS]
    ids = F.array_join("settlement_ids", ", ").alias("settlements")
    asked = F.concat(F.lit("Explain in one paragraph: credit "), F.col("bank_txn_id"), F.lit(" is "), F.col("resolution"), F.lit(" ("), squeeze(F.col("reason")), F.lit("); settlements: "), squeeze(F.array_join("settlement_ids", ", ")))
    return decisions.select("bank_txn_id", F.to_json(F.struct(*text, ids)).alias("verdict_json"), asked.alias("prompt"))


def verdicts_of_matches(decisions: DataFrame, classification: str | None = None) -> DataFrame:
    """(record_id, kind, category, amounts, facts, confidence) of decisions, all as text.

    A column of verdicts named by ``classification`` is added to the category and changes nothing.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    category = F.col("resolution") if classification is None else F.concat(F.col("resolution"), F.lit(" ("), F.col(classification), F.lit(")"))
    facts = F.array(text("reason"))
    if "evidence" in decisions.columns:
        facts = F.concat(facts, F.coalesce(F.transform(F.array_sort(F.map_entries("evidence")), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("none")))), F.array().cast("array<string>")))
    amounts = F.create_map(*[x for c in ("credit_minor", "net_minor", "residual_minor") for x in (F.lit(c), text(c))])
    return decisions.select(F.col("bank_txn_id").alias("record_id"), F.lit("match").alias("kind"), category.alias("category"), amounts.alias("amounts"), facts.alias("facts"), text("confidence").alias("confidence"))


def verdicts_of_variances(decomposed: DataFrame, id_col: str = "settlement_id") -> DataFrame:
    """(record_id, kind, category, amounts, facts, confidence) of settlements whose variance was attributed."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    amounts = F.create_map(*[x for c in ("expected_minor", "net_minor", "residual_minor", "fee_minor", "tax_minor") if c in decomposed.columns for x in (F.lit(c), text(c))])
    facts = F.transform(F.array_sort("candidates"), lambda c: F.concat(F.lit("candidate cause: "), c))
    return decomposed.select(F.col(id_col).cast("string").alias("record_id"), F.lit("variance").alias("kind"), F.col("attribution").alias("category"), amounts.alias("amounts"), facts.alias("facts"), F.lit(None).cast("string").alias("confidence"))


def verdict_prompts(verdicts: DataFrame) -> DataFrame:
    """(record_id, verdict_json, prompt) of verdicts of either kind; the prompt is one line and states what was decided."""
    body = F.to_json(F.struct("kind", "category", "amounts", "facts", "confidence"))
    asked = F.concat(F.lit("Explain in one paragraph, without changing it, the "), F.col("kind"), F.lit(" verdict "), squeeze(F.col("category")), F.lit(" on "), F.col("record_id"), F.lit(": "), squeeze(F.array_join("facts", "; ")))
    return verdicts.select("record_id", body.alias("verdict_json"), asked.alias("prompt"))


def template(decisions: DataFrame) -> DataFrame:
    """(bank_txn_id, explanation) without any model."""
    n = F.size("settlement_ids")
    covers = F.when(n == 0, "no settlement").when(n == 1, F.concat(F.lit("settlement "), F.element_at(F.when(n == 1, F.col("settlement_ids")), 1))).otherwise(F.concat(n.cast("string"), F.lit(" settlements")))
    return decisions.select("bank_txn_id", F.concat(F.lit("Credit "), F.col("bank_txn_id"), F.lit(": "), F.lower("resolution"), F.lit(", "), covers, F.lit(". "), squeeze(F.col("reason")), F.lit(".")).alias("explanation"))


def explain(decisions: DataFrame, ask: Callable[[str], str] | None = None) -> DataFrame:
    """(bank_txn_id, explanation): by ``ask``, called in the workers, or by the template if there is none."""
    if ask is None:
        return template(decisions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"bank_txn_id": batch["bank_txn_id"], "explanation": [ask(p) for p in batch["prompt"]]})

    return prompts(decisions).select("bank_txn_id", "prompt").mapInPandas(run, "bank_txn_id string, explanation string")
