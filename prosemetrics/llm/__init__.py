"""Operators for preparing training text at scale, and their queries.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
