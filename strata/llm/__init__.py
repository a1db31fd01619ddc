"""Operators for training-data pipelines over text corpora.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
