"""Whole runs: stage tables, what is stale, what to compute next."""
