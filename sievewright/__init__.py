"""A PySpark engine for explainable record-to-rule matching, retrieval, evaluation and data governance."""

__version__ = "0.1.0"
