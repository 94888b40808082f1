"""Operators for preparing text corpora for language models."""
