"""Guarding and metering of text at scale, as PySpark DataFrame jobs."""
