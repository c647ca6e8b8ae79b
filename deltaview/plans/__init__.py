"""Programs over the operators, and the registry of queries."""
