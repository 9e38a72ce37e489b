"""Registered queries: name -> (query, oracle SQL or None)."""
