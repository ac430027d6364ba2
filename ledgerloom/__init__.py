"""Settlement reconciliation and related analytics as Spark DataFrame operators."""
