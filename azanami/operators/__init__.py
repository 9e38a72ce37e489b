"""Relational operators that Spark lacks: prefix and fuzzy joins, ranges, spatial joins, skew handling."""
