"""Operators that prepare report corpora for language models; nothing outside this package imports it."""
