"""Subject-level cohort analytics expressed as Spark DataFrame queries."""
