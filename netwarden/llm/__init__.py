"""Operators for preparing text corpora that train language models."""
