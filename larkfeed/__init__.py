"""Snapshot reconciliation and price analytics as lazy Spark plans."""
