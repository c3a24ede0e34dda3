"""Operators for preparing language-model training text (one module each).

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
