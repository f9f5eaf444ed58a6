"""Relational operators over time-series points."""
