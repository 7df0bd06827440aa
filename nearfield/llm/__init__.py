"""Operators that prepare training text: extraction, counting, mixing,
deduplication, encoding, classification, fingerprints and media columns.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
