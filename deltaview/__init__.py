"""deltaview: incrementally maintained relational views on Spark."""
