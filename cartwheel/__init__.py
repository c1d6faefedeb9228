"""Two-stage purchase-history recommendation as Spark DataFrame operators."""
