"""Operators that prepare text and media for model training."""
