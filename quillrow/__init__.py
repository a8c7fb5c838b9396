"""A PySpark-native engine for a schema-driven, row-oriented binary container format."""

__version__ = "0.1.0"
