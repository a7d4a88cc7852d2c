"""Operators of a training-data pipeline over document, page and vector tables.

Nothing outside this folder imports it, apart from ``corpus_pipeline.py`` and the
guarded import in ``__spark_entry__.py``.
"""
