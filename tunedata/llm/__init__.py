"""Operators for preparing large text corpora for model training, one module per operator.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
