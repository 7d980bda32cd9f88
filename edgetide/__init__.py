"""Temporal-graph analytics on PySpark: reachability over edges that carry timestamps."""
