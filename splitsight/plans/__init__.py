"""Whole flows: each composes operators over tables and returns the tables it produces."""
