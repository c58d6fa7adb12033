"""Measurement analytics for still-image encoders, as PySpark DataFrame jobs."""
