"""Operators that prepare training corpora for language models."""
