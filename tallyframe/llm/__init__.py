"""Operators that prepare text corpora for training. Nothing outside imports this package."""
