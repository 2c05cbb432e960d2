"""Claim, evidence and verdict analytics as PySpark plans."""
