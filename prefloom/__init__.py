"""Preference-data analytics on Spark: judged responses in, audited pairs, splits and statistics out."""

__version__ = "0.1.0"
