"""Leakage-safe splitting and detector evaluation as PySpark DataFrame operators."""
