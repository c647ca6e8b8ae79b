from deltaview.operators import aggregates, invariants, joins, sets

__all__ = ["aggregates", "invariants", "joins", "sets"]
