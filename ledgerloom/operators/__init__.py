"""Reconciliation operators; each takes and returns DataFrames."""
