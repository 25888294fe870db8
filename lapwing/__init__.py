"""Lapwing: a PySpark engine for ordered signal and event data."""
