"""Operators for large-scale training-data pipelines.

The subpackage stands alone: nothing else in ``lectern`` imports it, and its
queries reach ``__spark_entry__.py`` through :mod:`lectern.llm.queries`.
"""
