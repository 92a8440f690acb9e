"""Operators of a training-data pipeline (one module per operator).

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
registers its queries when it is installed.
"""
