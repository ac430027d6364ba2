"""Export receivables against their realisation deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def age_receipts(receipts: DataFrame, as_of: Column) -> DataFrame:
    """Adds outstanding_minor, days_to_deadline and status; rows without a shipping bill are left out.

    Realised: nothing outstanding.  Open: realised in part, or past the deadline.  Aging: else.
    """
    open_ = F.col("invoice_minor") - F.coalesce("realised_minor", F.lit(0))
    days = F.datediff("realisation_deadline", as_of)
    part = (F.col("realised_minor") > 0) & (F.col("realised_minor") < F.col("invoice_minor"))
    status = F.when(open_ <= 0, "REALISED").when(F.coalesce(part, F.lit(False)) | F.coalesce(days < 0, F.lit(False)), "OPEN_EDPMS_LINKAGE").otherwise("AGING")
    return receipts.where(F.col("shipping_bill_no").isNotNull()).withColumns({"outstanding_minor": open_, "days_to_deadline": days, "status": status})


def open_exceptions(aged: DataFrame) -> DataFrame:
    """Open receipts, the most urgent first; the invoice id breaks ties."""
    return aged.where("status = 'OPEN_EDPMS_LINKAGE'").orderBy(F.coalesce("days_to_deadline", F.lit(0)), "invoice_id")
