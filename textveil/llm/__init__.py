"""Corpus operators for training-data preparation.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it; it imports nothing from the rest
of the library either, so both can be shipped apart.
"""
