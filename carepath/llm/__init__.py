"""Operators for large training-data corpora.

Nothing outside this folder imports it; ``queries.py`` holds the registered
queries and ``__spark_entry__.py`` adds them when the folder is present.
"""
