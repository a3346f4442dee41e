"""Guarded analytics on Spark: profile tables, gate metric requests, compute, reconcile, record."""
