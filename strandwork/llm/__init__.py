"""Operators for preparing text at training-corpus scale.

Nothing outside this subpackage imports it; `corpus_pipeline.py` chains five of its operators.
"""
