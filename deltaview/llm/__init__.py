"""Operators for large training-data corpora; nothing else in deltaview imports this package."""
