"""Price-integrity analytics on Spark."""
