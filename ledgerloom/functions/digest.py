"""Deterministic identifiers of decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest128(*parts: Column) -> Column:
    """32 hex digits of the parts, joined by NUL: the head of a SHA-256 (nulls count as empty)."""
    joined = F.array_join(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), "\x00")
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 32)


def basis_points(confidence: Column) -> Column:
    """A confidence in [0, 1] as whole basis points, half to even, clamped."""
    return F.greatest(F.lit(0), F.least(F.lit(10000), F.bround(confidence.cast("decimal(20,10)") * 10000, 0).cast("int")))
