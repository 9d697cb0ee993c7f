"""veyra: a PySpark-native engine for curated, evidence-backed catalogue data."""

__version__ = "0.1.0"
