"""Supervisory analytics for security operations centres, as Spark DataFrame jobs."""

__version__ = "0.1.0"
